"""Phrases by words, and what an entry may show."""

from pyspark.sql import functions as F

from cohortspark.plans import catalogue as G

CAUSE = G.Phrase("causal", [["cause", "causes"], ["cancer"]], ["not", "no", "never"], 3, ["randomised_controlled_trial"])


def test_denied_phrases_do_not_count(spark):
    texts = {
        "It causes cancer.": [1], "This does not cause cancer": [], "No evidence at all that it causes cancer": [6], "never (ever) causes cancer": [], "causes CANCER, cause cancer": [0, 2], "not so: a b c causes cancer": [5], "cancer causes": [], "": [], "causes": [],
    }
    d = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.p for r in d.select("t", G.phrase_places(G.words(F.col("t")), CAUSE).alias("p")).collect()}
    assert got == texts | {None: []}


def test_issues_and_routes(spark):
    rules = G.Rules("id", ["name"], ["note"], "url", "doi", "related", ["yes", "no"], "yes", "design", "unknown", [CAUSE])
    rows = [
        (1, "a", "fine", "https://x.y/z", "unknown", ["https://q"], ["say", "never say"], ["never say"], "cohort", None),
        (2, " ", "it causes cancer", "nowhere", "10.12/x", ["x"], ["say"], [""], None, ["odd"]),
        (3, "c", "it causes cancer", "unknown", "n.a.", [], None, None, "Randomised_Controlled_Trial", []),
        (4, "d", "fine", None, "10.1234/abc", None, ["say"], None, None, None), (4, "d", "fine", "https://x", None, None, None, None, None, None), (None, "e", "fine", "https://x", None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "id int, name string, note string, url string, doi string, related array<string>, yes array<string>, no array<string>, design string, unknown array<string>")
    found = G.issues(d, rules)
    assert sorted((r.id, r.issue) for r in found.collect()) == [
        (2, "causal"), (2, "empty"), (2, "empty statement"), (2, "no DOI"), (2, "no URL"), (2, "related source is no URL"), (2, "statements need a source"), (2, "unknown keys"), (3, "no source"), (4, "repeated key"),
    ]
    routes = {r.id: (r.route, r.statements) for r in G.shown(d, found, "id", "yes", "no").collect()}
    assert routes[1] == ("presentable", ["say"]) and routes[2][0] == "held" and routes[3] == ("research", []) and routes[4] == ("held", []) and routes[None] == ("presentable", [])
    assert G.issues(d.filter("false"), rules).count() == 0 and {(r.severity, r.issue): r.rows for r in G.summary(found).collect()}["soft", "no source"] == 1
