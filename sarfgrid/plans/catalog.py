"""Registered queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arabic as ar
from ..functions import roots, syllable
from ..functions import text as tx
from ..operators import context, evaluation, lookup, segmentation, tokens, verdicts
from . import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "word_gate_verdict"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column_query(name, source, key, col, spark_fn, sql_expr, out="out"):
    """A query that maps one column; registered with its SQL."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, spark_fn(F.col(col)).alias(out))

    run.__name__ = name
    query(f"SELECT {key}, {sql_expr} AS {out} FROM {source}")(run)


def vocabulary_query(name, spark_fn, sql_expr, out="out"):
    def run(spark, sf_dir):
        return tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select("surface", "n", spark_fn(F.col("surface")).alias(out))

    run.__name__ = name
    query(f"SELECT surface, n, {sql_expr} AS {out} FROM {sql.VOCABULARY}")(run)


# cleaning and tokenising
column_query("to_lowercase", "documents", "doc_id", "text", tx.to_lowercase, "lower(text)")
column_query("remove_punctuation", "documents", "doc_id", "text", tx.remove_punctuation, sql.no_punct("text"))
column_query("remove_extra_whitespace", "documents", "doc_id", "text", tx.remove_extra_whitespace, sql.squeeze("text"))
column_query("remove_numbers", "documents", "doc_id", "text", tx.remove_numbers, sql.rx("text", r"\p{Nd}+"))
column_query("remove_urls", "pages", "page_id", "url", tx.remove_urls, sql.rx("url", r"https?://\S+|www\.\S+"))
column_query("remove_html_tags", "pages", "page_id", "html", tx.remove_html_tags, sql.rx("html", "<[^>]+>"))
column_query("clean_text", "documents", "doc_id", "text", tx.clean, sql.squeeze(sql.no_punct(f"lower({sql.rx(sql.rx('text', '<[^>]+>'), r'https?://\S+|www\.\S+')})")))
column_query("clean_html", "pages", "page_id", "html", lambda c: tx.clean(c, remove_nums=True), sql.squeeze(sql.rx(sql.no_punct(f"lower({sql.rx(sql.rx('html', '<[^>]+>'), r'https?://\S+|www\.\S+')})"), r"\p{Nd}+")))
column_query("word_count", "documents", "doc_id", "text", lambda c: F.size(tx.word_tokenize(c)).cast("long"), f"len({sql.words('text')})::BIGINT")

_SENTENCES = f"""list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '([.!?])[ \\t\\n\\x0b\\x0c\\r]+', '\\1' || chr(1), 'g'), '^$', '', 'g'), chr(1)), lambda s: s <> '')"""


@query(f"SELECT doc_id, len({_SENTENCES})::BIGINT AS n, max(length(s.x))::BIGINT AS longest FROM documents, LATERAL (SELECT unnest({_SENTENCES}) AS x) AS s GROUP BY doc_id, text")
def sentence_stats(spark, sf_dir):
    s = tx.sentence_tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query(f"SELECT surface, count(*) AS n FROM {sql.TOKENS} GROUP BY 1 ORDER BY n DESC, surface LIMIT 100")
def token_freq_top100(spark, sf_dir):
    return tokens.words(table(spark, sf_dir, "documents")).groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface").limit(100)


@query(f"SELECT lang, count(DISTINCT w) AS vocabulary, count(*) AS tokens FROM (SELECT lang, unnest({sql.words('lower(text)')}) AS w FROM documents) AS t GROUP BY lang")
def vocab_by_lang(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.explode(tx.word_tokenize(F.lower("text"))).alias("w"))
    return w.groupBy("lang", "w").agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"))


@query(
    f"""SELECT doc_id, line, generate_subscripts(ws, 1) AS pos, unnest(ws) AS surface FROM (SELECT doc_id, line, {sql.words('r')} AS ws FROM
    (SELECT doc_id, generate_subscripts(rs, 1) AS line, unnest(rs) AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS rs FROM documents) AS a) AS b) AS c"""
)
def tokenize_with_lines(spark, sf_dir):
    return tokens.lines(table(spark, sf_dir, "documents"))


_P = ".,!?;:"
_PEEL = f"regexp_extract(surface, '^([{_P}]*)', 1)"
_REST = f"substr(surface, length({_PEEL}) + 1)"


@query(f"""SELECT l, r, count(*) AS n, min(length(c))::BIGINT AS shortest FROM (SELECT {_PEEL} AS l, regexp_extract({_REST}, '([{_P}]*)$', 1) AS r, left({_REST}, length({_REST}) - length(regexp_extract({_REST}, '([{_P}]*)$', 1))) AS c FROM {sql.TOKENS}) AS t GROUP BY 1, 2""")
def strip_punct_hist(spark, sf_dir):
    t = tokens.words(table(spark, sf_dir, "documents")).groupBy("surface").agg(F.count("*").alias("n")).select("n", tx.strip_punct(F.col("surface"), _P).alias("x"))
    return t.groupBy(F.col("x.left").alias("l"), F.col("x.right").alias("r")).agg(F.sum("n").alias("n"), F.min(F.length("x.core")).cast("long").alias("shortest"))


# script
vocabulary_query("strip_diacritics", ar.strip_diacritics, sql.strip("surface"))
vocabulary_query("normalize_hamza", ar.normalize_hamza, sql.hamza("surface"))
vocabulary_query("normalize_al", ar.normalize_al, sql.al("surface"))
vocabulary_query("normalize_shadda", ar.normalize_shadda, sql.shadda("surface"))
vocabulary_query("normalize", ar.normalize, sql.shadda(sql.al(sql.hamza("surface"))))
vocabulary_query("nfc", ar.nfc, "nfc_normalize(surface)")
vocabulary_query("canonical_normalize", ar.canonical_normalize, f"replace(nfc_normalize(surface), 'آ', {sql.q('ء' + ar.FATHA)})")
vocabulary_query("count_letters", lambda c: ar.count_letters(c).cast("long"), f"length({sql.rx('surface', '[^' + ar.LETTER[1:])})::BIGINT")
vocabulary_query("starts_with_article", ar.starts_with_article, f"starts_with({sql.strip('surface')}, 'ال') AND length({sql.strip('surface')}) > 2")
vocabulary_query("phones", lambda c: F.array_join(ar.phones(c), " "), f"array_to_string({sql.phones('surface')}, ' ')")
vocabulary_query("syllable_classes", syllable.classes, sql.classes("surface"))
vocabulary_query("syllable_slots", lambda c: syllable.slots(syllable.classes(c)), sql.slots(sql.classes("surface")))

_STATE = f"CASE WHEN regexp_matches(p, '[{ar.TANWIN}]') THEN 'TANWIN' WHEN regexp_matches(p, '[{ar.SHORT}]') THEN 'EXPLICIT_VOWEL' WHEN contains(p, '{ar.SUKUN}') THEN 'SUKUN' WHEN length(p) > 1 THEN 'OTHER' ELSE 'ABSENT' END"


@query(f"SELECT letter, state, sum(n)::BIGINT AS n FROM (SELECT left(p, 1) AS letter, {_STATE} AS state, n FROM (SELECT unnest({sql.phones('surface')}) AS p, n FROM {sql.VOCABULARY}) AS a) AS b GROUP BY 1, 2")
def mark_state_hist(spark, sf_dir):
    p = tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select(F.explode(ar.phones(F.col("surface"))).alias("p"), "n")
    return p.groupBy(F.left("p", F.lit(1)).alias("letter"), ar.mark_state(F.col("p")).alias("state")).agg(F.sum("n").alias("n"))


@query(f"SELECT verdict, count(*) AS words, sum(n)::BIGINT AS tokens FROM (SELECT {sql.gate('s')} AS verdict, n FROM (SELECT {sql.slots(sql.classes('surface'))} AS s, n FROM {sql.VOCABULARY}) AS a) AS b GROUP BY 1")
def word_gate_verdict(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select("n", syllable.slots(syllable.classes(F.col("surface"))).alias("s"))
    return v.groupBy(syllable.word_gate(F.col("s")).alias("verdict")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


@query(
    """WITH RECURSIVE w AS (SELECT '' AS word, '' AS state, 0 AS len UNION ALL
    SELECT word || e, to_state, len + 1 FROM w JOIN (VALUES ('', 'C', 'C'), ('C', 'V', 'CV'), ('CV', 'V', 'CVV'), ('CV', 'C', 'CVC'), ('CVV', 'C', 'CVVC'), ('CVC', 'C', 'CVCC'), ('CVVC', 'C', 'CVVCC'),
    ('CVC', 'V', 'CV'), ('CVVC', 'V', 'CV'), ('CVCC', 'V', 'CV'), ('CVVCC', 'V', 'CV')) AS t(from_state, e, to_state) ON state = from_state WHERE len < 8)
    SELECT len::BIGINT AS len, count(DISTINCT word) AS words FROM w WHERE len > 0 AND state <> 'C' GROUP BY len"""
)
def legal_words_by_len(spark, sf_dir):
    """Words of C and V up to eight letters that the slot grammar accepts; a consonant behind a whole slot may open the next."""
    steps = [(a, e, b) for (a, e), b in syllable.STEPS.items()] + [(s, "V", "CV") for s in ("CVC", "CVVC", "CVCC", "CVVCC")]
    t = F.broadcast(fixture(spark, steps, "f string, e string, to string"))
    level = fixture(spark, [("", "")], "word string, state string")
    out = None
    for k in range(1, 9):
        level = level.join(t, level["state"] == t["f"]).select(F.concat("word", "e").alias("word"), F.col("to").alias("state")).distinct()
        mine = level.where("state <> 'C'").agg(F.count_distinct("word").alias("words")).select(F.lit(k).cast("long").alias("len"), "words")
        out = mine if out is None else out.unionByName(mine)
    return out.where("words > 0")


# clitics and look-ups
_ENC = segmentation.ENCLITICS
_BARE = sql.strip("surface")


def _enclitic_sql():
    inflected = f"regexp_matches({_BARE}, {sql.q('(' + '|'.join(segmentation.INFLECTIONS) + ')$')})"
    arms = []
    for e in sorted(_ENC, key=lambda e: (-len(e), e)):
        tail = f"regexp_extract(surface, {sql.q('(' + ''.join(x + ar.MARK + '*' for x in e) + ')$')}, 1)"
        stem = f"left({_BARE}, length({_BARE}) - {len(e)})"
        letters = f"length({sql.rx(stem, '[^' + ar.LETTER[1:])}) >= 2"
        more = f" AND NOT suffix({_BARE}, 'ونا')" if e == "نا" else ""
        arms.append(f"WHEN suffix({_BARE}, {sql.q(e)}) AND {letters} AND NOT regexp_matches({tail}, '[{ar.TANWIN}]'){more} THEN {sql.q(e)}")
    return f"CASE WHEN {inflected} THEN NULL {' '.join(arms)} END"


vocabulary_query("enclitic", segmentation.enclitic, _enclitic_sql())


def _proclitic_sql():
    rest_bare, rest = f"substr({_BARE}, 2)", f"regexp_replace(surface, {sql.q('^.' + ar.MARK + '*')}, '')"
    article = f"(starts_with({sql.strip(rest)}, 'ال') AND length({sql.strip(rest)}) > 2)"
    arms = []
    for letter, vowel, kind in segmentation.PROCLITICS:
        marks = f"regexp_extract(surface, {sql.q('^' + letter + '(' + ar.MARK + '*)')}, 1)"
        fits = f"starts_with({_BARE}, {sql.q(letter)}) AND ({marks} = '' OR starts_with({marks}, {sql.q(vowel)})) AND ({article} OR length({sql.rx(rest_bare, '[^' + ar.LETTER[1:])}) >= {segmentation.LEAST[kind]})"
        if kind == "FUTURE_PARTICLE":
            fits += f" AND regexp_matches({rest_bare}, '^[يتنأ]')"
        arms.append(f"WHEN {fits} THEN {sql.q(kind + ':' + letter)}")
    return f"CASE {' '.join(arms)} END"


vocabulary_query("proclitic", lambda c: F.concat(segmentation.proclitic(c)["kind"], F.lit(":"), segmentation.proclitic(c)["particle"]), _proclitic_sql())

_SPAN = f"regexp_extract(surface, {sql.q('^(ا' + ar.MARK + '*ل' + ar.MARK + '*)')}, 1)"
_HAS = f"(starts_with({_BARE}, 'ال') AND length({_BARE}) > 2)"
_SOLAR = f"regexp_matches(substr(surface, length({_SPAN}) + 1), {sql.q('^[' + ar.SOLAR + ']' + ar.MARK + '*' + ar.SHADDA)})"


@query(f"SELECT CASE WHEN NOT {_HAS} THEN 'none' WHEN {_SOLAR} THEN 'solar' ELSE 'lunar' END AS kind, count(*) AS words, sum(n)::BIGINT AS tokens FROM {sql.VOCABULARY} GROUP BY 1")
def article_kinds(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents"))
    return v.groupBy(ar.article_span(F.col("surface"))["kind"].alias("kind")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


# A test catalogue: transliterated words with owners; the same bare key may have several vocalised forms.
CATALOGUE = [("تهَ", "OPERATOR"), ("اِن", "PARTICLE"), ("وف", "OPERATOR"), ("تهاراِن", "NAME"), ("هِس", "PRONOUN"), ("هَس", "VERB"), ("ات", "NOUN"), ("اتَ", "NOUN")]
_BAREKEY = sql.strip("vocalised")


@query(
    f"""SELECT tier, owner, count(*) AS words, sum(n)::BIGINT AS tokens FROM (SELECT n, CASE WHEN e.k IS NOT NULL THEN 'EXACT' WHEN forms = 1 THEN 'BARE' WHEN forms > 1 THEN 'COLLISION' ELSE 'NONE' END AS tier,
    CASE WHEN e.k IS NOT NULL THEN e.o WHEN forms = 1 THEN b.o END AS owner FROM {sql.VOCABULARY} AS v
    LEFT JOIN (SELECT vocalised AS k, min(owner) AS o FROM {sql.values(CATALOGUE, 'vocalised, owner')} GROUP BY 1) AS e ON e.k = surface
    LEFT JOIN (SELECT {_BAREKEY} AS k, count(DISTINCT vocalised) AS forms, min(owner) AS o FROM {sql.values(CATALOGUE, 'vocalised, owner')} GROUP BY 1) AS b ON b.k = {_BARE}) AS t GROUP BY 1, 2"""
)
def lookup_cascade(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents"))
    return lookup.cascade(v, fixture(spark, CATALOGUE, "vocalised string, owner string")).groupBy("tier", "owner").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


_SUFFIXES = ["tion", "ing", "ed", "er", "s", "mente", "ment", "ción", "keit", "heit"]
_LONGEST = "CASE " + " ".join(f"WHEN suffix(surface, '{a}') AND length(surface) >= {len(a) + 2} THEN '{a}'" for a in sorted(_SUFFIXES, key=lambda a: (-len(a), a))) + " END"


@query(f"SELECT {_LONGEST} AS suffix, count(*) AS n, count(DISTINCT surface) AS words FROM {sql.TOKENS} GROUP BY 1")
def longest_suffix(spark, sf_dir):
    w = tokens.words(table(spark, sf_dir, "documents")).groupBy("surface").agg(F.count("*").alias("n"))
    return w.groupBy(lookup.longest_affix(F.col("surface"), _SUFFIXES, 2, end=True).alias("suffix")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedupe_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min_by("source", "doc_id").alias("source"))


# roots and verdicts
_W = lambda xs: "(" + ", ".join(sql.q(x) for x in xs) + ")"
_FA, _AYN, _LAM = "substr(r, 1, 1)", "substr(r, 2, 1)", "substr(r, 3, 1)"
_RSRC = f"(SELECT array_to_string(list_filter(string_split({sql.rx('surface', '[^' + ar.LETTER[1:])}, ''), lambda z: z <> ''), '') AS r, n FROM {sql.VOCABULARY})"
_REASON = f"""CASE WHEN length(r) < 2 THEN 'insufficient_consonants' WHEN length(r) = 2 THEN 'two_consonant_form_unresolved' WHEN length(r) = 4 THEN 'quadriliteral_beyond_scope' WHEN length(r) > 4 THEN 'non_standard_consonant_count'
 WHEN {_FA} IN {_W('وي')} AND {_LAM} IN {_W('اىي')} AND {_AYN} NOT IN {_W('او')} THEN 'lafif_mafruq_unresolved' WHEN {_AYN} IN {_W('او')} AND {_LAM} IN {_W('اىي')} THEN 'lafif_maqrun_unresolved'
 WHEN {_AYN} IN {_W('او')} THEN 'hollow_underlying_radical_unresolved' WHEN {_LAM} IN {_W('اىي')} THEN 'defective_lam_unresolved' WHEN {_FA} IN {_W('وي')} THEN 'assimilated_fa_unresolved' WHEN regexp_matches(r, '[اىأإؤئآ?]') THEN 'prohibited_or_ambiguous_radical' END"""


@query(
    f"""SELECT CASE WHEN length(r) < 2 THEN 'BLOCK' WHEN reason IS NOT NULL THEN 'DEFER' ELSE 'ACCEPT' END AS directive, reason,
    CASE WHEN reason IS NULL THEN CASE WHEN contains(r, 'ء') THEN 'hamza' WHEN {_AYN} = {_LAM} OR {_FA} = {_AYN} THEN 'geminate' ELSE 'sound' END END AS kind, count(*) AS words, sum(n)::BIGINT AS tokens
    FROM (SELECT r, n, {_REASON} AS reason FROM {_RSRC} AS a) AS b GROUP BY 1, 2, 3"""
)
def root_class(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents"))
    r = roots.analyse_radicals(F.regexp_replace("surface", "[^" + ar.LETTER[1:], ""))
    return v.select("n", r.alias("x")).groupBy("x.directive", "x.reason", "x.kind").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


_UP = ["BLOCK", "BLOCKED", "DEFER", "DEFERRED", "RESIDUAL", "ACCEPT", "LICENSED", "COMPLETE", "odd", "", None]
_GATE = ["LICENSED", "BLOCKED", "REJECTED", "FORBIDDEN_LEAP", "RESIDUAL", "DEFERRED", "?", None]
_PAIRS = [(a, b) for a in _UP for b in _GATE]


@query(
    f"""SELECT up, tq, CASE WHEN u IN ('BLOCKED', 'BLOCK') OR t IN ('BLOCKED', 'BLOCK', 'REJECTED', 'FORBIDDEN_LEAP') THEN 'BLOCKED' WHEN u IN ('DEFERRED', 'DEFER') THEN 'DEFERRED' WHEN u = 'RESIDUAL' THEN 'RESIDUAL'
    WHEN u IN ('ACCEPTED', 'LICENSED', 'ACCEPT', 'COMPLETE') AND t IN ('LICENSED', 'RESIDUAL') THEN t ELSE 'DEFERRED' END AS verdict
    FROM (SELECT *, coalesce(nullif(upper(trim(up)), ''), 'DEFERRED') AS u, coalesce(nullif(upper(trim(tq)), ''), 'DEFERRED') AS t FROM {sql.values(_PAIRS, 'up, tq')} AS p) AS x"""
)
def verdict_compose(spark, sf_dir):
    return fixture(spark, _PAIRS, "up string, tq string").withColumn("verdict", verdicts.compose(F.col("up"), F.col("tq")))


_STATUS = [(b, d, u, r) for b in ("NONE", "WARNING", "BLOCKER") for d in ("NONE", "MINOR", "INVALIDATING") for u in (True, False) for r in (3, 4)]


@query(f"SELECT *, CASE WHEN blocker = 'BLOCKER' OR defect = 'INVALIDATING' THEN 'BATIL' WHEN defect = 'MINOR' OR blocker = 'WARNING' THEN 'FASID' WHEN unmet OR rank < 4 THEN 'DEFERRED' ELSE 'SAHIH' END AS status FROM {sql.values(_STATUS, 'blocker, defect, unmet, rank')} AS t")
def stage_status(spark, sf_dir):
    t = fixture(spark, _STATUS, "blocker string, defect string, unmet boolean, rank int")
    return t.withColumn("status", verdicts.stage_status(F.col("blocker"), F.col("defect"), F.col("unmet"), F.col("rank")))


@query("SELECT lang, sum((w > 1000)::INT)::BIGINT AS block, sum((w BETWEEN 50 AND 1000)::INT)::BIGINT AS accept, sum((w < 50)::INT)::BIGINT AS defer FROM (SELECT lang, len(" + sql.words("text") + ") AS w FROM documents) AS t GROUP BY 1")
def layer_state_pivot(spark, sf_dir):
    w = F.size(tx.word_tokenize(F.col("text")))
    d = table(spark, sf_dir, "documents").select("lang", F.when(w > 1000, "block").when(w < 50, "defer").otherwise("accept").alias("state"))
    return d.groupBy("lang").pivot("state", ["block", "accept", "defer"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"SELECT surface, n, substr(sha256({sql.strip('surface')} || '|' || n::VARCHAR), 1, 16) AS claim_key FROM {sql.VOCABULARY}")
def claim_key(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents"))
    return v.select("surface", "n", F.substring(F.sha2(F.concat_ws("|", ar.strip_diacritics(F.col("surface")), F.col("n").cast("string")), 256), 1, 16).alias("claim_key"))


# context
_J, _S, _N, _PRE = ["to", "of"], ["for", "that"], ["to"], ["and", "the"]


@query(
    f"""SELECT mood, count(*) AS n FROM (SELECT CASE WHEN s1 IN {_W(_N)} AND coalesce(s2 IN {_W(_PRE)}, false) THEN NULL WHEN s1 IN {_W(_J)} THEN 'JUSSIVE' WHEN s1 IN {_W(_S)} THEN 'SUBJUNCTIVE' END AS mood
    FROM (SELECT lag(surface, 1) OVER w AS s1, lag(surface, 2) OVER w AS s2 FROM {sql.TOKENS} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) AS a) AS b GROUP BY 1"""
)
def mood_context(spark, sf_dir):
    return context.govern_mood(tokens.words(table(spark, sf_dir, "documents")), _J, _S, _N, _PRE).groupBy("mood").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, lag(length(text), 1) OVER w AS prev_len, turn - last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark, sf_dir):
    return context.carry_speaker(table(spark, sf_dir, "conversations"))


# evaluation
@query("SELECT field, sum((want IS NOT NULL)::INT)::BIGINT AS compared, sum((want IS NOT NULL AND got IS DISTINCT FROM want)::INT)::BIGINT AS mismatches FROM (SELECT 'quality' AS field, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS got, quality AS want FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', CASE WHEN contains(text, 'idiot') THEN 1 ELSE 0 END, toxic FROM documents JOIN labels USING (doc_id)) AS t GROUP BY 1")
def gold_mismatch_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("quality"), F.when(F.contains("text", F.lit("idiot")), 1).otherwise(0).alias("toxic"))
    return evaluation.gold_mismatches(d, table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'ADDED' WHEN b.doc_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
    CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END) END AS fields
    FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0) AS a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 0) AS b ON a.doc_id = b.doc_id
    WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang OR a.n_chars IS DISTINCT FROM b.n_chars"""
)
def snapshot_diff(spark, sf_dir):
    """The table against an altered version of itself: the two snapshots are the feature under test, and both are whole tables with known edits."""
    d = table(spark, sf_dir, "documents")
    new = d.where("doc_id % 11 <> 0").select("doc_id", F.when(F.expr("doc_id % 5 = 0"), "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.expr("doc_id % 3 = 0"), F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return evaluation.snapshot_diff(d.where("doc_id % 7 <> 0"), new, "doc_id", ["lang", "n_chars"])


@query("""SELECT 'known_language' AS "check", sum((NOT coalesce(lang IN ('en', 'fr', 'de', 'es'), false))::INT)::BIGINT AS n FROM documents UNION ALL SELECT 'length_stated', sum((NOT coalesce(n_chars = length(text), false))::INT)::BIGINT FROM documents UNION ALL SELECT 'no_markup', sum((NOT coalesce(NOT regexp_matches(text, '<[a-z]+>'), false))::INT)::BIGINT FROM documents""")
def contract_violations(spark, sf_dir):
    checks = {"known_language": F.col("lang").isin("en", "fr", "de", "es"), "length_stated": F.col("n_chars") == F.length("text"), "no_markup": ~F.col("text").rlike("<[a-z]+>")}
    return evaluation.violations(table(spark, sf_dir, "documents"), checks)


@query("SELECT lang, sum((lang = 'en' AND text IS NOT NULL AND contains(text, 'the') AND starts_with(source, 'src'))::INT)::BIGINT AS passed, count(*) AS n FROM documents GROUP BY 1")
def probe_results(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ok = evaluation.probe({c: F.col(c) for c in d.columns}, [("lang", "eq", "en"), ("text", "not_none", None), ("text", "contains", "the"), ("source", "starts_with", "src")])
    return d.groupBy("lang").agg(F.sum(ok.cast("long")).alias("passed"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value, round(avg(value), 6) AS mean_value, max(value) AS worst FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("worst"))


@query("SELECT source, lang, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM documents GROUP BY 1, 2")
def wc_accounting(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 9))


# patterns, derivation, inflection
from ..operators import inflection, patterns, spans  # noqa: E402


def _fit_sql():
    arms = []
    for pattern, name, _ in patterns.WAZN:
        want = patterns.template_cells(pattern)
        at = {r: next(k for k, c in enumerate(want) if c[0] == r) + 1 for r in patterns.RADICALS}
        tests = [f"len(c) = {len(want)}"]
        for k, cell in enumerate(want):
            letter = f"left(c[{at[cell[0]]}], 1)" if cell[0] in patterns.RADICALS else sql.q(cell[0])
            tests.append(f"left(c[{k + 1}], 1) = {letter}")
            if k < len(want) - 1 and cell[0] not in "اوي":
                tests.append(f"substr(c[{k + 1}], 2) = {sql.q(cell[1:])}")
        arms.append(f"CASE WHEN {' AND '.join(tests)} THEN {sql.q(name)} END")
    return f"list_filter([{', '.join(arms)}], lambda z: z IS NOT NULL)"


@query(
    f"""SELECT surface, n, len(f)::BIGINT AS n_fits, CASE WHEN len(f) = 1 THEN 'ACCEPT' WHEN len(f) > 1 THEN 'DEFER' ELSE 'BLOCK' END AS verdict, array_to_string(f, ' ') AS wazn_ids
    FROM (SELECT surface, n, {_fit_sql()} AS f FROM (SELECT surface, n, {sql.phones('surface')} AS c FROM {sql.VOCABULARY}) AS a) AS b"""
)
def pattern_match_verdict(spark, sf_dir):
    return patterns.match(tokens.arabic_vocabulary(table(spark, sf_dir, "documents")))


_ROOTS = f"(SELECT DISTINCT r AS root FROM {_RSRC} AS a WHERE length(r) = 3 AND {_REASON} IS NULL)"


def _roots(spark, sf_dir):
    letters = F.regexp_replace("surface", "[^" + ar.LETTER[1:], "")
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select(letters.alias("root")).distinct()
    return v.where(roots.analyse_radicals(F.col("root"))["directive"] == "ACCEPT")


def _fill(p):
    for k, c in enumerate("\ue001\ue002\ue003"):
        p = f"replace({p}, {sql.q(c)}, substr(root, {k + 1}, 1))"
    return p


_FILLED = _fill(f"translate(pattern, {sql.q(patterns.RADICALS)}, {sql.q(chr(0xE001) + chr(0xE002) + chr(0xE003))})")


@query(f"SELECT root, type, family, pattern, transitivity, {_FILLED} AS form FROM {_ROOTS} AS r CROSS JOIN {sql.values(patterns.DERIVATIVES, 'type, family, pattern, transitivity')} AS t")
def derive_forms(spark, sf_dir):
    return patterns.derive(_roots(spark, sf_dir), patterns.DERIVATIVES, ["type", "family", "pattern", "transitivity"])


@query(f"SELECT root, bab_id, pattern, {_FILLED} AS form FROM {_ROOTS} AS r CROSS JOIN {sql.values(patterns.MASDAR, 'bab_id, pattern')} AS t")
def masdar_projection(spark, sf_dir):
    return patterns.derive(_roots(spark, sf_dir), patterns.MASDAR, ["bab_id", "pattern"])


@query(f"SELECT past_vowel, imperfect_vowel, family, count(*) AS classes, min(bab_id) AS first_class, CASE WHEN count(*) = 1 THEN 'ACCEPT' ELSE 'DEFER' END AS verdict FROM {sql.values(patterns.BAB, 'bab_id, family, past, imperfect, past_vowel, imperfect_vowel')} AS t GROUP BY 1, 2, 3")
def bab_projection(spark, sf_dir):
    b = fixture(spark, patterns.BAB, "bab_id string, family string, past string, imperfect string, past_vowel string, imperfect_vowel string")
    g = b.groupBy("past_vowel", "imperfect_vowel", "family").agg(F.count("*").alias("classes"), F.min("bab_id").alias("first_class"))
    return g.withColumn("verdict", F.when(F.col("classes") == 1, "ACCEPT").otherwise("DEFER"))


_CELLS = inflection.cells("a", "u")


@query(
    f"""SELECT root, tense, mood, voice, person, number, gender, pre || substr(root, 1, 1) || first || substr(root, 2, 1) || second || substr(root, 3, 1) || ending AS form
    FROM {_ROOTS} AS r CROSS JOIN {sql.values(_CELLS, 'tense, mood, voice, person, number, gender, pre, first, second, ending')} AS t"""
)
def conjugation(spark, sf_dir):
    return inflection.conjugate(_roots(spark, sf_dir), "a", "u")


def _past_png_sql():
    u, o, a, i, sh = ar.DAMMA, ar.SUKUN, ar.FATHA, ar.KASRA, ar.SHADDA
    bare = sql.strip("form")
    tests = [
        (f"suffix(form, 'ت{u}ن{sh}{a}')", "2 PL F"), (f"suffix({bare}, 'تما')", "2 DU M"), (f"suffix({bare}, 'تم')", "2 PL M"), (f"suffix({bare}, 'نا')", "1 PL M"), (f"suffix({bare}, 'وا')", "3 PL M"),
        (f"suffix(form, '{o}ن{a}')", "3 PL F"), (f"suffix(form, 'ت{a}ا')", "3 DU F"), (f"suffix({bare}, 'ا') AND NOT suffix({bare}, 'تا')", "3 DU M"),
        (f"suffix(form, 'ت{i}')", "2 SG F"), (f"suffix(form, 'ت{a}')", "2 SG M"), (f"suffix(form, 'ت{u}')", "1 SG M"), (f"suffix(form, 'ت{o}')", "3 SG F"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN {sql.q(v)}" for t, v in tests) + " ELSE '3 SG M' END"


_PASSIVE = f"regexp_matches(form, {sql.q('^' + ar.LETTER + ar.MARK + '*' + ar.DAMMA + ar.MARK + '*' + ar.LETTER + ar.MARK + '*' + ar.KASRA)})"
_FORMS = f"""SELECT tense, voice, person, number, gender, pre || substr(root, 1, 1) || first || substr(root, 2, 1) || second || substr(root, 3, 1) || ending AS form
    FROM {_ROOTS} AS r CROSS JOIN {sql.values(_CELLS, 'tense, mood, voice, person, number, gender, pre, first, second, ending')} AS t WHERE tense = 'PAST'"""


@query(f"SELECT voice, person, number, gender, count(*) AS forms, sum(({_past_png_sql()} = person || ' ' || number || ' ' || gender AND CASE WHEN {_PASSIVE} THEN 'PASSIVE' ELSE 'ACTIVE' END = voice)::INT)::BIGINT AS recovered FROM ({_FORMS}) AS f GROUP BY 1, 2, 3, 4")
def past_features_round_trip(spark, sf_dir):
    """Features read back from generated past forms of all roots; those of roots that end like an ending are ambiguous by their letters."""
    forms = inflection.conjugate(_roots(spark, sf_dir), "a", "u", tenses=("PAST",))
    f = forms.withColumn("f", inflection.past_features(F.col("form")))
    same = F.lit(True)
    for c in ("voice", "person", "number", "gender"):
        same = same & (F.col(c) == F.col("f")[c])
    return f.groupBy("voice", "person", "number", "gender").agg(F.count("*").alias("forms"), F.sum(same.cast("long")).alias("recovered"))


@query(
    f"""SELECT op, count(*) AS cells, sum(length(m) - length(c))::BIGINT AS grown FROM (SELECT c, m, CASE WHEN c = m THEN 'IDENTITY' WHEN length(c) = length(m) THEN 'REPLACE' ELSE 'EXPAND' END AS op
    FROM (SELECT c, {sql.shadda(sql.hamza('c'))} AS m FROM (SELECT unnest(regexp_extract_all(surface, {sql.q('(?s)' + ar.LETTER + ar.MARK + '*|.')})) AS c FROM {sql.VOCABULARY}) AS a) AS b) AS d GROUP BY 1"""
)
def normalization_span_ops(spark, sf_dir):
    s = spans.normalization_spans(tokens.arabic_vocabulary(table(spark, sf_dir, "documents")))
    return s.groupBy("op").agg(F.count("*").alias("cells"), F.sum(F.col("norm_end") - F.col("norm_start") - F.col("raw_end") + F.col("raw_start")).alias("grown"))




@query(
    f"""SELECT kind, count(*) AS words, sum(n)::BIGINT AS tokens FROM (SELECT n, CASE WHEN length(c) < 2 THEN 'UNDERLICENSED_SHORT_SURFACE' WHEN length(c) = 2 THEN CASE WHEN c = 'MS' THEN 'COMPRESSED_VERB_CANDIDATE' ELSE 'UNDERLICENSED_SHORT_SURFACE' END
    WHEN length(regexp_replace(c, '[AVWF]', '', 'g')) >= 2 THEN 'ROOT_ELIGIBLE' ELSE 'NON_VERBAL_SURFACE' END AS kind FROM (SELECT n, {sql.classes('surface')} AS c FROM {sql.VOCABULARY}) AS a) AS b GROUP BY 1"""
)
def boundary_structure(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select("n", syllable.classes(F.col("surface")).alias("c"))
    kind = (
        F.when(F.length("c") < 2, "UNDERLICENSED_SHORT_SURFACE")
        .when(F.length("c") == 2, F.when(F.col("c") == "MS", "COMPRESSED_VERB_CANDIDATE").otherwise("UNDERLICENSED_SHORT_SURFACE"))
        .when(F.length(F.regexp_replace("c", "[AVWF]", "")) >= 2, "ROOT_ELIGIBLE")
        .otherwise("NON_VERBAL_SURFACE")
    )
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


# letters, tense, slots, traces, metrics
from ..functions import glyphs  # noqa: E402
from ..operators import slots as typed  # noqa: E402
from ..operators import tense as tenses  # noqa: E402

_CELL = f"(SELECT left(p, 1) AS letter, p, n FROM (SELECT unnest({sql.phones('surface')}) AS p, n FROM {sql.VOCABULARY}) AS a)"
_VW = f"[{ar.SHORT}{ar.TANWIN}]"
_BASE = f"CASE WHEN letter = 'ء' THEN 'HAMZA' WHEN regexp_matches(letter, '^[{glyphs.HAMZA_CARRIERS}]$') THEN 'HAMZA_CARRIER' WHEN letter IN ('ا', 'و', 'ي') THEN 'LONG_VOWEL_LETTER' WHEN letter = 'ى' THEN 'ALEF_MAQSURA' WHEN letter = 'ة' THEN 'TAA_MARBUTA' ELSE 'CONSONANT' END"


@query(
    f"""SELECT base, kind, licensed, count(*) AS cells, sum(n)::BIGINT AS tokens FROM (SELECT {_BASE} AS base, CASE WHEN letter IN ('ا', 'ى') OR (letter IN ('و', 'ي') AND NOT regexp_matches(p, '{_VW}')) THEN 'V' WHEN regexp_matches(p, '{_VW}') THEN 'CV' ELSE 'C' END AS kind,
    (length(regexp_replace(p, '[^{_VW[1:]}', '', 'g')) <= 1 AND NOT (length(regexp_replace(p, '[^{_VW[1:]}', '', 'g')) = 1 AND contains(p, '{ar.SUKUN}'))) AS licensed, n FROM {_CELL} AS c) AS d GROUP BY 1, 2, 3""".replace("]]", "]")
)
def glyph_classes(spark, sf_dir):
    p = tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select(F.explode(ar.phones(F.col("surface"))).alias("p"), "n")
    c = p.select(glyphs.base_class(F.left("p", F.lit(1))).alias("base"), glyphs.cell_kind(F.col("p")).alias("kind"), glyphs.licensed(F.col("p")).alias("licensed"), "n")
    return c.groupBy("base", "kind", "licensed").agg(F.count("*").alias("cells"), F.sum("n").alias("tokens"))


def _tense_sql():
    m, lt = ar.MARK + "*", ar.LETTER + ar.MARK + "*"
    s = f"(CASE WHEN length(surface) >= 4 AND regexp_matches(surface, '^[وف]{ar.FATHA}') THEN substr(surface, 3) ELSE surface END)"
    hit = lambda p: f"regexp_matches({s}, {sql.q(p)})"
    bare = sql.strip(s)
    fatha, damma = hit(f"^[{tenses.PREFIXES}]{m}{ar.FATHA}"), hit(f"^[{tenses.PREFIXES}]{m}{ar.DAMMA}")
    twice = "|".join(f"{x}{m}{ar.SUKUN}{m}{x}" for x in "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي")
    longer = f"{fatha} AND {hit('^' + lt * 4)} AND NOT suffix({bare}, 'وا') AND (suffix({bare}, 'ونا') OR NOT regexp_matches({bare}, '({'|'.join(tenses.PAST_ENDS)})$')) AND length({bare}) >= 5 AND {hit('^[يتن]')}"
    arms = [
        f"{fatha} AND {hit('^' + lt + ar.LETTER + m + ar.SUKUN)}", damma, f"{fatha} AND {hit('^' + lt + lt + ar.LETTER + m + ar.SHADDA)}",
        f"{fatha} AND {hit('^' + lt + ar.LETTER + m + '[' + ar.DAMMA + ar.KASRA + ']' + m + '[ويا]' + m + ar.LETTER)}",
        f"({fatha} OR {damma}) AND {hit('^' + lt * 4)} AND {hit('^' + lt + '(' + lt + ')*(' + twice + ')')}", longer,
    ]
    imp = f"{hit('^' + lt * 3)} AND ({' OR '.join('(' + x + ')' for x in arms)})"
    fourth = f"{hit('^[ءأ]' + m + ar.FATHA)} AND {hit('^' + lt + ar.LETTER + m + ar.SUKUN)} AND suffix({bare}, 'وا')"
    order = f"{hit('^[اٱ]' + m + '[^ل' + ar.MARKS + ']' + m + ar.SUKUN + m + ar.LETTER)} AND NOT (suffix({bare}, 'ان') AND length({bare}) > 4)"
    eighth = hit("^[اٱ]" + m + ar.LETTER + m + ar.SHADDA + m + ar.LETTER + m + ar.DAMMA + m + ar.LETTER)
    lam = f"length({s}) >= 4 AND {hit('^ل' + ar.SUKUN)}"
    return f"CASE WHEN surface = '' THEN NULL WHEN {lam} THEN 'IMPERFECT' WHEN {fourth} THEN 'IMPERATIVE' WHEN {imp} THEN 'IMPERFECT' WHEN ({order}) OR ({eighth}) THEN 'IMPERATIVE' ELSE 'PAST' END"


vocabulary_query("tense_label", tenses.tense, _tense_sql())


def _ending_sql():
    b = _BARE
    last = f"regexp_extract(surface, {sql.q('(' + ar.MARK + ')$')}, 1)"
    return f"""CASE WHEN suffix({b}, 'ون') AND length({b}) > 4 THEN 'PL M INDICATIVE' WHEN suffix({b}, 'ين') THEN 'SG F INDICATIVE' WHEN suffix({b}, 'ان') THEN 'DU M INDICATIVE' WHEN suffix({b}, 'ن') AND NOT suffix({b}, 'ون') THEN 'PL F INDICATIVE'
    WHEN suffix({b}, 'وا') THEN 'PL M SUBJUNCTIVE' WHEN suffix({b}, 'ي') AND starts_with({b}, 'ت') THEN 'SG F SUBJUNCTIVE' WHEN suffix({b}, 'ا') AND NOT suffix({b}, 'نا') AND NOT suffix({b}, 'تا') THEN 'DU M SUBJUNCTIVE'
    ELSE 'SG M ' || CASE {last} WHEN {sql.q(ar.FATHA)} THEN 'SUBJUNCTIVE' WHEN {sql.q(ar.SUKUN)} THEN 'JUSSIVE' ELSE 'INDICATIVE' END END"""


vocabulary_query("imperfect_ending", tenses.imperfect_ending, _ending_sql())


@query(
    f"""SELECT surface, substr(sha256('WORD|' || 'LETTERS=' || length({sql.rx('surface', '[^' + ar.LETTER[1:])}) || '|PATTERN=' || CASE WHEN len(f) = 1 THEN f[1] ELSE '?' END || '|TENSE=' || {_tense_sql()}), 1, 16) AS claim,
    CASE WHEN len(f) > 1 THEN 'AMBIGUOUS' WHEN len(f) = 0 THEN 'UNKNOWN' ELSE 'KNOWN' END AS pattern_state FROM (SELECT surface, {_fit_sql()} AS f FROM (SELECT surface, {sql.phones('surface')} AS c FROM {sql.VOCABULARY}) AS a) AS b"""
)
def typed_slot_claims(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents"))
    s = F.array(
        typed.slot("PATTERN", "MORPHOLOGY", F.lit(None).cast("string"), F.transform(patterns.fits(F.col("surface")), lambda x: x["wazn_id"])),
        typed.slot("TENSE", "MORPHOSYNTAX", tenses.tense(F.col("surface"))),
        typed.slot("LETTERS", "SURFACE", ar.count_letters(F.col("surface"))),
    )
    v = v.select("surface", s.alias("slots"))
    return v.select("surface", typed.claim_digest("WORD", F.col("slots")).alias("claim"), F.col("slots")[0]["state"].alias("pattern_state"))


@query(
    """SELECT doc_id, sum((rank >= 4)::INT)::BIGINT AS licensed, max(rank) AS highest_rank, max(stage) AS last_stage FROM (SELECT *, coalesce(max((status = 'BATIL')::INT) OVER (PARTITION BY doc_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
    FROM (SELECT doc_id, stage, ((doc_id + stage) % 5)::INT AS rank, CASE WHEN (doc_id * 7 + stage) % 11 = 0 THEN 'BATIL' WHEN (doc_id + stage) % 5 < 4 THEN 'DEFERRED' ELSE 'SAHIH' END AS status FROM documents, (SELECT unnest(range(1, 20)) AS stage) AS s) AS t) AS u WHERE stopped = 0 GROUP BY 1"""
)
def stage_trace(spark, sf_dir):
    """Nineteen stages a document with statuses that follow from its id; each trace ends at its first BATIL."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(19).cast("long"))).alias("stage"))
    rank = F.expr("(doc_id + stage) % 5").cast("int")
    t = d.withColumn("rank", rank).withColumn("status", F.when(F.expr("(doc_id * 7 + stage) % 11 = 0"), "BATIL").when(rank < 4, "DEFERRED").otherwise("SAHIH"))
    return typed.trace_summary(typed.stop_at_first(t, "doc_id", "stage", "status"), "doc_id")


_AGREE = """SELECT doc_id, pos, (surface IN ('is', 'was', 'are', 'be') OR starts_with(surface, 'th')) AS elig, surface IN ('she', 'her', 'of') AS fem, surface IN ('and', 'to') AS bnd, surface = 'that' AS joined, length(surface) % 2 = 0 AS other FROM """ + sql.TOKENS


@query(
    f"""WITH t AS ({_AGREE} AS k), a AS (SELECT *, elig AND (coalesce(lead(fem, 1) OVER w, false) OR (NOT coalesce(lead(bnd, 1) OVER w, false) AND (coalesce(lead(fem, 2) OVER w, false) OR (NOT coalesce(lead(bnd, 2) OVER w, false) AND coalesce(lead(fem, 3) OVER w, false))))) AS a FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    e AS (SELECT *, CASE WHEN a THEN true WHEN NOT elig AND bnd AND other THEN false END AS ev FROM a), c AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM e)
    SELECT doc_id, sum(elig::INT)::BIGINT AS eligible, sum((a OR (elig AND joined AND coalesce(carried, false)))::INT)::BIGINT AS resolved FROM c GROUP BY 1"""
)
def agreement_context(spark, sf_dir):
    s = F.col("surface")
    t = tokens.words(table(spark, sf_dir, "documents")).select(
        "doc_id", "pos", (s.isin("is", "was", "are", "be") | s.startswith("th")).alias("elig"), s.isin("she", "her", "of").alias("fem"), s.isin("and", "to").alias("bnd"), (s == "that").alias("joined"), (F.length(s) % 2 == 0).alias("other")
    )
    return context.resolve_subject(t).groupBy("doc_id").agg(F.sum(F.col("elig").cast("long")).alias("eligible"), F.sum(F.col("resolved").cast("long")).alias("resolved"))


@query("SELECT source, forms, lang, kind, CASE WHEN forms >= 2 AND lang IS NOT NULL AND kind IS NOT NULL THEN 'ACCEPT' ELSE 'DEFER' END AS verdict FROM (SELECT source || '-' || (n_chars % 50) AS source, count(*) AS forms, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS kind FROM (SELECT *, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS kind FROM documents) AS d GROUP BY 1) AS t")
def root_consensus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), (F.col("n_chars") % 50).cast("string")).alias("source"), "lang", F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("kind"))
    return evaluation.consensus(d, "source", ["lang", "kind"])


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(doc_id || '|' || text || '|' || lang || '|' || source || '|' || n_chars), 1, 15))::BIGINT)::VARCHAR AS digest FROM documents")
def manifest_digest(spark, sf_dir):
    return evaluation.table_digest(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query("""SELECT 'repeated_key' AS "check", (count(text) - count(DISTINCT text))::BIGINT AS n FROM documents UNION ALL SELECT 'missing_lang', sum((lang IS NULL)::INT)::BIGINT FROM documents UNION ALL SELECT 'missing_source', sum((source IS NULL)::INT)::BIGINT FROM documents""")
def integrity_check(spark, sf_dir):
    return evaluation.integrity(table(spark, sf_dir, "documents"), "text", ["lang", "source"])


_SUF3 = ["tion", "ing", "ed", "er", "th"]


@query(
    "WITH RECURSIVE s AS (SELECT surface, surface AS host, 0 AS depth FROM (SELECT DISTINCT surface FROM " + sql.TOKENS + ") AS t UNION ALL "
    "SELECT surface, left(host, length(host) - length(a)) AS host, depth + 1 AS depth FROM s JOIN (SELECT unnest(['tion', 'ing', 'ed', 'er', 'th']) AS a) AS x ON suffix(host, a) AND length(host) - length(a) >= 2 WHERE depth < 3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY depth DESC, length(host), host) AS k FROM s) SELECT depth::BIGINT AS depth, count(*) AS words, sum(length(surface) - length(host))::BIGINT AS stripped FROM r WHERE k = 1 GROUP BY 1"
)
def attached_suffixes(spark, sf_dir):
    """Suffixes stripped up to three deep; the deepest reading wins, then the one that strips most. Endings exclude each other, so a reading is a chain."""
    w = tokens.words(table(spark, sf_dir, "documents")).select("surface").distinct().withColumn("host", F.col("surface")).withColumn("depth", F.lit(0).cast("long"))
    for _ in range(3):
        a = lookup.longest_affix(F.col("host"), _SUF3, 2, end=True)
        w = w.select("surface", F.when(a.isNull(), F.col("host")).otherwise(F.left("host", F.length("host") - F.length(a))).alias("host"), (F.col("depth") + a.isNotNull().cast("long")).alias("depth"))
    return w.groupBy("depth").agg(F.count("*").alias("words"), F.sum(F.length("surface") - F.length("host")).alias("stripped"))


# segmentation, word class, registries, runs
from ..operators import wordclass  # noqa: E402


def _segments_sql():
    """whole, route, particle, host and pronoun of the vocabulary, peeled in nested selects whose column is always ``surface``."""
    inside = f"SELECT surface AS whole, n, {_proclitic_sql()} AS pro FROM {sql.VOCABULARY}"
    rest = f"SELECT *, CASE WHEN pro IS NULL THEN whole ELSE regexp_replace(whole, {sql.q('^.' + ar.MARK + '*')}, '') END AS surface FROM ({inside}) AS s1"
    after = f"substr(surface, length({_SPAN}) + 1)"
    light = f"regexp_replace({after}, {sql.q('^([' + ar.SOLAR + '][' + ar.MARKS.replace(ar.SHADDA, '') + ']*)' + ar.SHADDA)}, '\\1')"
    host = f"SELECT whole, n, pro, {_HAS} AS art, CASE WHEN NOT {_HAS} THEN surface WHEN {_SOLAR} THEN {light} ELSE {after} END AS surface FROM ({rest}) AS s2"
    tails = " ".join(f"WHEN {sql.q(e)} THEN regexp_extract(surface, {sql.q('(' + ''.join(c + ar.MARK + '*' for c in e) + ')$')}, 1)" for e in segmentation.ENCLITICS)
    cut = f"SELECT *, CASE enc {tails} ELSE '' END AS tail FROM (SELECT *, {_enclitic_sql()} AS enc FROM ({host}) AS s3) AS s4"
    route = f"CASE WHEN whole IN {_W(segmentation.PROTECTED)} THEN 'PROTECTED' WHEN whole IN {_W(segmentation.OPERATORS)} THEN 'OPERATOR' ELSE concat_ws('+', CASE WHEN pro IS NOT NULL THEN 'PROCLITIC' END, CASE WHEN art THEN 'ARTICLE' END, 'HOST', CASE WHEN enc IS NOT NULL THEN 'ENCLITIC' END) END"
    return f"(SELECT whole, n, {route} AS route, art, enc, left(surface, length(surface) - length(tail)) AS host FROM ({cut}) AS s5)"


@query(f"SELECT whole AS surface, n, route, CASE WHEN route IN ('PROTECTED', 'OPERATOR') THEN whole ELSE host END AS host, CASE WHEN route NOT IN ('PROTECTED', 'OPERATOR') THEN enc END AS pronoun FROM {_segments_sql()} AS s")
def segment_one_particle(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents")).select("surface", "n", segmentation.segment(F.col("surface")).alias("s"))
    return v.select("surface", "n", "s.route", "s.host", "s.pronoun")


_VERBS = _W(wordclass.VERBAL)


def _word_class_sql():
    seg = f"SELECT *, {sql.gate('sl')} AS gate FROM (SELECT *, {sql.slots('cl')} AS sl FROM (SELECT whole, n, route, art, host AS surface, {sql.classes('whole')} AS cl FROM {_segments_sql()} AS s) AS w4) AS w5"
    fit = f"SELECT *, {_fit_sql()} AS f, {_tense_sql()} AS t FROM (SELECT *, {sql.phones('surface')} AS c FROM ({seg}) AS w1) AS w2"
    verbs = f"len(list_filter(f, lambda z: z IN {_VERBS}))"
    return f"""SELECT n, CASE WHEN gate = 'BLOCK' THEN 'UPSTREAM_BLOCK' WHEN route = 'OPERATOR' THEN 'OPERATOR' WHEN route = 'PROTECTED' THEN 'CLOSED_CLASS' WHEN art THEN 'ARTICLE' WHEN regexp_matches(whole, '[{ar.TANWIN}]') THEN 'TANWIN' WHEN suffix({_BARE}, 'ة') THEN 'TAA_MARBUTA'
    WHEN t = 'IMPERFECT' THEN 'IMPERFECT_PREFIX' WHEN t = 'IMPERATIVE' THEN 'IMPERATIVE_SHAPE' WHEN len(f) > 0 AND {verbs} = len(f) THEN 'VERBAL_PATTERN' WHEN len(f) > 0 AND {verbs} = 0 THEN 'NOMINAL_PATTERN' WHEN len(f) > 0 THEN 'AMBIGUOUS_PATTERN' ELSE 'NO_PATTERN' END AS reason FROM ({fit}) AS w3"""


@query(f"SELECT CASE WHEN reason = 'OPERATOR' THEN 'HARF' WHEN reason IN ('IMPERFECT_PREFIX', 'IMPERATIVE_SHAPE', 'VERBAL_PATTERN', 'AMBIGUOUS_PATTERN') THEN 'FI3L' WHEN reason <> 'UPSTREAM_BLOCK' THEN 'ISM' END AS word_class, reason, count(*) AS words, sum(n)::BIGINT AS tokens FROM ({_word_class_sql()}) AS w GROUP BY 1, 2")
def word_class(spark, sf_dir):
    v = tokens.arabic_vocabulary(table(spark, sf_dir, "documents"))
    v = v.withColumn("slots", syllable.slots(syllable.classes(F.col("surface")))).withColumn("gate", syllable.word_gate(F.col("slots")))
    c = v.select("n", wordclass.classify(F.col("surface"), F.col("gate")).alias("c"))
    return c.groupBy("c.word_class", "c.reason").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


@query("SELECT doc_id, 'DUPLICATE' AS fault FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) AS o GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT doc_id, 'DANGLING' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def registry_faults(spark, sf_dir):
    """Documents without a label dangle; toxic rows are entered twice on purpose."""
    owners = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return evaluation.registry_faults(owners.unionByName(owners.where("toxic = 1")).select("doc_id"), table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT count(*) AS n, sum((kinds = 1 AND seen = 3)::INT)::BIGINT AS stable, sum((seen < 3)::INT)::BIGINT AS missing FROM (SELECT doc_id, count(DISTINCT run) AS seen, count(DISTINCT lang || '/' || len) AS kinds FROM (SELECT doc_id, 1 AS run, lang, n_chars AS len FROM documents UNION ALL SELECT doc_id, 2, lang, length(text) FROM documents UNION ALL SELECT doc_id, 3, lang, length(trim(text)) FROM documents WHERE lang <> 'es') AS r GROUP BY 1) AS t")
def compare_runs(spark, sf_dir):
    """Three readings of a document's length: as stated, counted, and trimmed (this one without Spanish)."""
    d = table(spark, sf_dir, "documents")
    r = lambda k, c, w: d.where(w).select("doc_id", F.lit(k).alias("run"), "lang", c.cast("long").alias("len"))
    runs = r(1, F.col("n_chars"), "true").unionByName(r(2, F.length("text"), "true")).unionByName(r(3, F.length(F.trim("text")), "lang <> 'es'"))
    return evaluation.agreement_of_runs(runs, "doc_id", "run", ["lang", "len"])


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'size', CASE WHEN n_chars > 5000 THEN 'long' WHEN n_chars > 500 THEN 'middle' ELSE 'short' END AS v, count(*) FROM documents GROUP BY v")
def summary_stats(spark, sf_dir):
    size = F.when(F.col("n_chars") > 5000, "long").when(F.col("n_chars") > 500, "middle").otherwise("short")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in (("lang", F.col("lang")), ("source", F.col("source")), ("size", size))])
    return table(spark, sf_dir, "documents").select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


# operators over public example rows, with the rows that they must give
from . import cases  # noqa: E402

QUERIES.update(cases.QUERIES)
ORACLES.update(cases.ORACLES)
