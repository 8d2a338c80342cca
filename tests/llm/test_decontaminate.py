"""Seeds of test items: what they must find, and how much they make the search look at."""

import duckdb
import numpy as np
from corpus_fixtures import WORDS

from peneira.llm import decontaminate, queries
from peneira.llm.hashing import ngram_hashes, word_hashes

SF = "/root/testdata/sf0.001"


def chosen(items, texts):
    """Seeds by plain counts of all n-grams of the texts."""
    hashes, bounds = word_hashes(texts)
    grams = [ngram_hashes(hashes[a:b], decontaminate.SEED_WORDS) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    found, counts = np.unique(np.concatenate(grams), return_counts=True)
    items.keep_rare(found, counts, len(hashes))
    return items


def windows(items, texts):
    hashes, bounds = word_hashes(texts)
    return sum(len(found) for _, found in decontaminate._candidates(items, hashes, bounds))


def test_every_run_of_four_words_that_occurs_holds_a_seed(monkeypatch):
    monkeypatch.setattr(decontaminate, "RARE_LEAST", 3)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS[:6], 80)) for _ in range(20)]
    items = chosen(decontaminate.Items(list(range(30)), [" ".join(rng.choice(WORDS[:6], 25)) for _ in range(30)]), texts)
    assert len(items.seeds[0].grams) and len(items.seeds[1].grams)
    hashes, bounds = word_hashes(texts)
    hit = {(s.n, int(p), int(o), int(q)) for s in items.seeds for p, r, _ in zip(*decontaminate._inside(s, hashes, bounds), strict=True)
           for o, q in [(s.owners[k], s.places[k]) for k in range(r, len(s.grams)) if s.grams[k] == s.grams[r]]}
    for owner, words in enumerate(items.words):
        for q in range(len(words) - 3):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for p in range(a, b - 3):
                    if (hashes[p : p + 4] == words[q : q + 4]).all():
                        assert hit & {(4, p, owner, q), (3, p, owner, q), (3, p + 1, owner, q + 1)}


def test_work_grows_little_with_the_items():
    rng = np.random.default_rng(7)
    share = 1 / np.arange(1, 5001)
    draw = lambda n: " ".join(f"w{k}" for k in rng.choice(5000, n, p=share / share.sum()))
    texts = [draw(500) for _ in range(200)]
    few, many = ([draw(60) for _ in range(n)] for n in (40, 4000))
    seen = {}
    for name, some in (("few", few), ("many", many)):
        every = decontaminate.Items(list(range(len(some))), some)
        seen[name] = windows(every, texts), windows(chosen(every, texts), texts)
    assert seen["many"][1] < seen["many"][0] / 8
    # Of a hundred thousand words, few are looked at for any of the 4000 items.
    assert seen["many"][1] < 0.2 * 200 * 500


def test_against_alignment_of_every_document_with_every_item(spark):
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, coalesce(text, '') from '{SF}/benchmark.parquet'").fetchall()
    passing, sure = {}, set()
    words = {i: word_hashes([t])[0] for i, t in items}
    for doc_id, text in docs:
        own = word_hashes([text])[0]
        runs = set(ngram_hashes(own, 4).tolist())
        for item_id, item in words.items():
            if len(own) and len(item) >= 3:
                best, _ = decontaminate.align(own[None, :], np.array([len(own)]), item)
                if best[0] >= decontaminate.needed(len(item)):
                    passing[doc_id, item_id] = int(best[0])
                    if runs & set(ngram_hashes(item, 4).tolist()):
                        sure.add((doc_id, item_id))
    got = {(r["doc_id"], r["item_id"]): r["aligned_score"] for r in queries.op2_decontaminate(spark, SF).collect()}
    assert sure and sure <= set(got) <= set(passing)
    assert all(got[k] <= passing[k] for k in got)
    assert {k for k in got if got[k] == passing[k]} >= sure


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    item = " ".join(f"own{k}" for k in range(30))
    items = spark.createDataFrame([(k, item.replace("own", f"i{k}n")) for k in range(8)], "item_id long, text string")
    assert len(decontaminate._blocks(items)) > 2
    docs = spark.createDataFrame([(k, "x " + item.replace("own", f"i{k}n")) for k in range(8)] + [(9, "clean text")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == {(k, k) for k in range(8)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [9]
