"""Stored groups, near-duplicate index and term index: batch by batch the same as at once."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_similarity import corpus

from peneira.operators import keyed, similarity, tagging
from peneira.operators.groups import StoredGroups, dup_groups
from peneira.operators.near_index import NearIndex
from peneira.operators.term_index import TermIndex
from peneira.session import scratch_path


def links(spark, edges):
    return spark.createDataFrame(edges, "id_a long, id_b long")


def test_groups_grow_as_links_come(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(1, i) for i in range(2, 40)]
    loose = [(rng.randrange(200, 280), rng.randrange(200, 280)) for _ in range(40)]
    edges = [*chain, *star, *loose, (None, 7), (500, 500)]
    rng.shuffle(edges)
    # The last batch joins large groups, and to an id smaller than all others.
    batches = [edges[:60], [], [*edges[60:], (130, 2), (0, 240)]]
    stored, seen = StoredGroups(spark, scratch_path(spark, "groups"), "long"), []
    for batch in batches:
        stored.add(links(spark, batch))
        seen += batch
    assert rows(stored.groups()) == rows(dup_groups(links(spark, seen)))


def test_groups_after_an_add_that_was_broken_off(spark, monkeypatch):
    stored = StoredGroups(spark, scratch_path(spark, "groups"), "long")
    stored.add(links(spark, [(1, 2), (3, 4)]))
    last = [(2, 9), (9, 3), (0, 9)]
    fail = monkeypatch.context()
    with fail as m:
        m.setattr(type(links(spark, [(1, 1)]).write), "mode", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            stored.add(links(spark, last))
    stored.add(links(spark, last))
    assert rows(stored.groups()) == rows(dup_groups(links(spark, [(1, 2), (3, 4), *last])))


def test_stored_members_are_not_shuffled(spark):
    stored = StoredGroups(spark, scratch_path(spark, "groups"), "long")
    stored.add(links(spark, [(i, i + 1) for i in range(0, 2000, 2)]))
    ends = spark.createDataFrame([(4,), (5,)], "id long")
    plan = stored.members().join(F.broadcast(ends), "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("threshold", [0.3, 1.0])
def test_near_index_in_batches_equals_the_whole(spark, monkeypatch, threshold):
    monkeypatch.setattr(keyed, "ROWS_PER_CELL", 3)
    monkeypatch.setattr(keyed, "WORK_PER_CELL", 20)
    docs = [*corpus(int(threshold * 10)), (900, None), (901, "um dois")]
    frame = spark.createDataFrame(docs, "id long, text string")

    def rounded(df):
        return sorted((r["id_a"], r["id_b"], round(r["jaccard"], 12)) for r in df.collect())

    whole = rounded(similarity.near_dup_pairs(frame, "id", "text", threshold))
    index, found = NearIndex(spark, scratch_path(spark, "near"), threshold), []
    for name, low, high in (("a", 0, 50), ("none", 50, 50), ("d", 50, 1000)):
        batch = frame.where((F.col("id") >= low) & (F.col("id") < high))
        new = rounded(index.add(batch, "id", "text", name))
        found += new
    assert sorted(found) == whole
    # A batch that is added again finds the same and leaves nothing twice.
    assert rounded(index.add(batch, "id", "text", "d")) == new
    assert index._read("sets", "set_key string, id {id}, shingles array<long>, batch string").groupBy("id").count().where("count > 1").isEmpty()


def test_near_index_whatever_the_order_of_batches(spark):
    docs = spark.createDataFrame(corpus(8), "id long, text string")
    whole = similarity.near_dup_pairs(docs, "id", "text", 0.5)
    index, found = NearIndex(spark, scratch_path(spark, "near"), 0.5), None
    for name, part in (("late", F.col("id") >= 50), ("early", F.col("id") < 50)):
        new = index.add(docs.where(part), "id", "text", name)
        found = new if found is None else found.unionByName(new)
    assert rows(dup_groups(found)) == rows(dup_groups(whole))


LONG_TERM = "um dois tres quatro cinco seis sete oito nove dez onze doze"
JOBS = [
    ("j1", "Dev PHP e Node.js", "usa phpunit, C++ e php; um dois tres"),
    ("j2", None, f"... {LONG_TERM}! spring boot boot"),
    ("j3", "boot spring boot", None),
    ("j4", "", ""),
    ("j5", "a b a b a c", LONG_TERM.replace("nove", "dez")),
    ("j6", "php", "php " * 500 + "spring"),
]
TERMS = [("php", True), ("node.js", True), ("c++", True), ("spring boot", True), ("boot", False), ("a b a c", False), (LONG_TERM, False),
         ("um dois", False), ("zzz", False)]


@pytest.fixture(scope="module")
def jobs(spark):
    frame = spark.createDataFrame(JOBS, "job_id string, title string, description string")
    return frame.withColumns({"posted_at": F.lit(None).cast("date"), "company": F.lit("x"), "location": F.lit("São Paulo")})


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(TERMS, "term_norm string, is_technology boolean")


EXPECTED = {
    "j1": ["c++", "node.js", "php", "um dois"],
    "j2": ["boot", "spring boot", "um dois", LONG_TERM],
    "j3": ["boot", "spring boot"],
    "j5": ["a b a c", "um dois"],
    "j6": ["php"],
}


def tags(df):
    return {r["job_id"]: (sorted(r["terms"]), sorted(r["title_terms"]), sorted(r["technologies"])) for r in df.collect()}


@pytest.mark.parametrize("max_heads", [tagging.MAX_HEADS, 1])
def test_terms_are_found_where_their_first_word_stands(spark, monkeypatch, jobs, dictionary, max_heads):
    monkeypatch.setattr(tagging, "MAX_HEADS", max_heads)
    found = tags(tagging.tag_terms(jobs, dictionary))
    assert {j: t[0] for j, t in found.items()} == {j: sorted(t) for j, t in EXPECTED.items()}
    assert found["j3"][1] == ["boot", "spring boot"] and found["j1"][1] == ["node.js", "php"] and found["j2"][1] == []
    assert tagging.tag_terms(jobs, dictionary.limit(0)).isEmpty()


def test_term_index_in_batches_equals_the_whole(spark, jobs, dictionary):
    index = TermIndex(spark, scratch_path(spark, "terms"))
    assert index.tags(dictionary).isEmpty()
    index.add_terms(dictionary.where("is_technology"), "t1")
    index.add_postings(jobs.where("job_id < 'j4'"), "p1")
    index.add_terms(dictionary, "t2")
    index.add_postings(jobs.where("job_id >= 'j4'"), "p2")
    index.add_terms(dictionary, "t3")
    whole = tags(tagging.tag_terms(jobs, dictionary))
    assert tags(index.tags(dictionary)) == whole
    assert rows(index.facts()) == rows(tagging.posting_facts(jobs))
    index.add_postings(jobs.where("job_id < 'j4'"), "p1")
    index.add_terms(dictionary, "t2")
    assert tags(index.tags(dictionary)) == whole
    # A profile's term that is gone is not shown.
    assert "php" not in tags(index.tags(dictionary.where("term_norm != 'php'")))["j1"][0]


def test_new_terms_are_searched_in_words_only(spark, jobs, dictionary):
    index = TermIndex(spark, scratch_path(spark, "terms"))
    index.add_postings(jobs, "p1")
    plan = index.search(dictionary.select("term_norm"))._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "In(token" in plan
