"""Clashing columns and many rules of the URL filter."""

from tabforge.llm import urlfilter

RULES = [("block", "example.com", "/en/"), ("allow", "com", "/")]


def test_clashing_columns_stay_under_free_names(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/x", "mine", "r", "v", "h2")],
                                  "page_id long, path string, host string, rule string, verdict string, host_ string")
    want = {"page_id": 1, "path_": "http://www.example.com/en/x", "host__": "mine", "rule_": "r", "verdict_": "v", "host_": "h2",
            "host": "www.example.com", "path": "/en/x", "rule": "example.com/en/", "verdict": "block"}
    for most in (10, 0):
        assert [r.asDict() for r in urlfilter.judge(pages, RULES, url="path", max_broadcast=most).collect()] == [want]


def test_paths_of_very_many_lengths_all_match(spark):
    """More than 100,000 distinct path lengths would be out of reach here; 3,000 lengths over
    two hosts go the same way, through the lengths each host has."""
    rules = [("block", f"h{n % 2}.net", "/" + "a" * n) for n in range(3000)]
    pages = spark.createDataFrame([(n, f"http://x.h{n % 2}.net/" + "a" * n) for n in (0, 1, 2, 1500, 2999, 3500)], "page_id long, url string")
    trie = urlfilter.judge(pages, rules)
    joined = urlfilter.judge(pages, rules, max_broadcast=0)
    got = {r.page_id: r.rule for r in joined.collect()}
    assert got == {r.page_id: r.rule for r in trie.collect()}
    assert got[2999] == "h1.net/" + "a" * 2999 and got[3500] == "h0.net/" + "a" * 2998
