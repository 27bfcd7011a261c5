import json

import pytest

from sarfgrid.sources import catalogs as ct

BAB = {"bab_id": "B1", "family": "MUJARRAD", "past_pattern": "x", "imperfect_pattern": "y", "past_wazn_id": "W1", "past_ayn_vowel": "a", "imperfect_ayn_vowel": "u", "required_surface_evidence": ["paired_paradigm"], "verbal_only": True, "license_status": "ACTIVE", "evidence_rank": 1}
CELL = {"role": "FA", "vowel": "FATHA"}
WAZN = {"wazn_id": "W1", "pattern": "p", "root_arity": 3, "family": "f", "applicable_surface_classes": [], "root_slots": ["R1"], "licensed_ziyadah_slots": [], "licensed_shadda_behavior": [], "licensed_weak_operations": [], "evidence_rank": 1, "source": "s", "template": [CELL, CELL | {"role": "AIN"}, CELL | {"role": "LAM"}]}


def path(tmp_path, key, entries):
    p = tmp_path / "catalogue.json"
    p.write_text(json.dumps({key: entries}), encoding="utf-8")
    return str(p)


def test_verb_classes_are_read_and_checked(spark, tmp_path):
    two = [BAB, BAB | {"bab_id": "B2", "example_verb": "v", "odd": 1}]
    got = ct.load_bab_catalog(spark, path(tmp_path, "abwab", two)).orderBy("bab_id").collect()
    assert [(r.bab_id, r.example_verb, r.verbal_only) for r in got] == [("B1", None, True), ("B2", "v", True)]
    for bad in ([BAB, BAB], [BAB | {"family": "x"}], [BAB | {"past_ayn_vowel": "e"}], [{k: v for k, v in BAB.items() if k != "past_pattern"}]):
        with pytest.raises(ct.CatalogError):
            ct.load_bab_catalog(spark, path(tmp_path, "abwab", bad))
    assert ct.load_bab_catalog(spark, path(tmp_path, "other", [])).count() == 0


def test_patterns_are_read_and_checked(spark, tmp_path):
    assert ct.load_wazn_catalog(spark, path(tmp_path, "awzan", [WAZN])).first().template[1].role == "AIN"
    added = {"role": "ZIYADAH", "vowel": "FATHA", "letter": "م"}
    ct.load_wazn_catalog(spark, path(tmp_path, "awzan", [WAZN | {"template": [added, *WAZN["template"]]}]))
    t = WAZN["template"]
    for bad in ([t[1], t[0], t[2]], t[:2], [*t, added | {"letter": None}], [*t, added | {"geminate_of": "FA"}], [*t, CELL | {"role": "X"}], [CELL | {"vowel": "?"}, *t[1:]], []):
        with pytest.raises(ct.CatalogError):
            ct.load_wazn_catalog(spark, path(tmp_path, "awzan", [WAZN | {"template": bad}]))
    with pytest.raises(ct.CatalogError):
        ct.load_wazn_catalog(spark, path(tmp_path, "awzan", []))


def test_inactive_entries_go_and_rules_are_lines(spark, tmp_path):
    m = {"masdar_id": "M1", "family": "f", "source_type": "LEXICAL_LICENSED", "bab_id": "B1"}
    rows = ct.load_masdar_catalog(spark, path(tmp_path, "masadir", [m, m | {"masdar_id": "M2", "license_status": "OFF"}])).collect()
    assert [r.masdar_id for r in rows] == ["M1"]
    p = tmp_path / "rules.jsonl"
    p.write_text('{"id": "r1", "form_families": ["F1"]}\n{"id": "r2", "form_families": []}\n', encoding="utf-8")
    rules = ct.load_rules(spark, str(p), "id string, form_families array<string>")
    from sarfgrid.operators.lookup import rules_for

    assert {r.id for r in rules_for(rules, "F1").collect()} == {"r1", "r2"}
    assert {r.id for r in rules_for(rules, "F2").collect()} == {"r2"}


def test_closed_class_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(",".join(ct.MABNI_FIELDS) + "\nM1,هُوَ,هو,OVERT,PRONOUN,SG,f,1,True,CLOSED,,,\nM2,,,LATENT,PRONOUN,SG,f,2,True,CLOSED,,,\n", encoding="utf-8")
    rows = ct.load_mabni_catalog(spark, str(p))
    assert ct.get_all_rows(rows).count() == 2
    assert [r.surface for r in ct.get_all_overt_surfaces(rows).collect()] == ["هو"]
    q = tmp_path / "o.csv"
    q.write_text(",".join(ct.OPERATOR_FIELDS) + "\nإِنَّ,g,G,1,p,True\nx,g,G,1,p,False\n", encoding="utf-8")
    assert [r.surface for r in ct.load_operators(spark, str(q)).collect()] == ["إِنَّ"]


def test_patterns_with_free_and_long_vowels_are_read(spark, tmp_path):
    cells = [CELL, {"role": "ZIYADAH", "vowel": "MATER", "letter": "ا"}, {"role": "AIN", "vowel": "KASRA"}, {"role": "LAM", "vowel": "FINAL"}]
    assert ct.load_wazn_catalog(spark, path(tmp_path, "awzan", [WAZN | {"template": cells}])).count() == 1
