"""Names across titles and without them, and forms that run out."""

import re

from tabforge.llm import surrogates


def test_one_given_name_is_one_surrogate_and_untitled_mentions_go(spark):
    text = "Dr. John Smith wrote. Mr. John Smith signed. Mrs. Smith and Smith agreed. John Smith left; JOHN, Smithers and john stay. a@b.org"
    docs = spark.createDataFrame([(1, text, "n"), (2, "Smith alone is no detected person here.", "n")], "doc_id long, text string, new string")
    rows = {r.doc_id: r.text for r in surrogates.replace(docs.withColumnRenamed("new", "names")).collect()}
    m = re.fullmatch(r"Dr\. (\w+) (\w+) wrote\. Mr\. (\w+) (\w+) signed\. Mrs\. (\w+) and (\w+) agreed\. (\w+) (\w+) left; "
                     r"(\w+), Smithers and john stay\. \S+@\S+\.org", rows[1])
    assert m and m[1] == m[3] == m[7] and m[2] == m[4] == m[5] == m[6] == m[8] and m[9] == m[1].upper()
    assert m[1] in surrogates.GIVEN["latin"]["m"] and "Smith" not in m.groups()
    assert rows[2] == "Smith alone is no detected person here."


def test_short_forms_never_run_out(spark):
    mails = [f"{a}@{b}.co" for a in range(10) for b in range(10)]
    phones = [f"+49 22 {n:02d}" for n in range(22, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(mails + phones)], "doc_id long, text string")
    got = [r.text for r in surrogates.replace(docs).collect()]
    assert len(set(got)) == len(got) == 178 and not set(got) & set(mails + phones)
    assert sum(bool(re.fullmatch(r"[a-z]*\d@\d\.co", t)) for t in got) == 100
    assert sum(bool(re.fullmatch(r"\+49 \d\d \d\d+", t)) for t in got) == 78


def test_map_against_one_entity_after_another(spark):
    """Distinct per kind, never a real entity, least first where two draw the same form."""
    rows = [("given_latin", f"name{i}", "mfn"[i % 3]) for i in range(60)] + [("given_latin", "adrian", "m"), ("given_latin", "alma", "f")]
    rows += [("given_latin", "name1", "m"), ("surname_greek", "x", None), ("ip", "1.2.3.4", None)]
    got = surrogates.surrogate_map(spark.createDataFrame(rows, "kind string, norm string, gender string"), "k").collect()
    assert {(r.kind, r.norm) for r in got} == {(k, n) for k, n, _ in rows} and len(got) == len({(r.kind, r.surrogate.lower()) for r in got})
    assert not {(r.kind, r.surrogate.lower()) for r in got} & {(k, n) for k, n, _ in rows}
    starts = lambda r, g: any(r.surrogate.startswith(x) for x in surrogates.GIVEN["latin"][g])
    by = {(r.kind, r.norm): r for r in got}
    genders = {n: {g for k, m, g in rows if m == n} for _, n, _ in rows}
    for (kind, norm), r in by.items():
        if kind == "given_latin":
            g = genders[norm]
            assert starts(r, "n" if len(g) > 1 else min(g)), (norm, r.surrogate)
