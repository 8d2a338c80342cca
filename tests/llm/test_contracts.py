"""Queries of the corpus operators against plain Python over the whole sf0.001 tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from peneira.llm import queries

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text, add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def test_token_counts(spark, texts, tokenizer):
    lengths = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts.values()]
    found = rows(spark, "op1_token_counts")
    assert {r["n_tokens"]: r["n_docs"] for r in found} == Counter(lengths)
    for r in found:
        n = r["n_tokens"]
        assert r["docs_from"] == sum(v >= n for v in lengths)
        assert r["tokens_from"] == sum(v for v in lengths if v >= n)
        assert r["truncated_total"] == sum(min(v, n) for v in lengths)
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))


def _simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    fps = {k: _simhash(t) for k, t in texts.items()}
    root = {k: k for k in fps}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op3_simhash")}
    assert found == {k: (f"{fp:016x}", top(k)) for k, fp in fps.items()}


def test_token_frames(spark, texts, tokenizer):
    expected, start = {}, 0
    for k in sorted(texts):
        ids = ids_of(tokenizer, texts[k], 0)
        expected[k] = (start, len(ids), crc(ids))
        start += len(ids)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op4_token_frames")}
    assert found == expected


def test_exact_dedup(spark, texts):
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[hashlib.sha256(BLANK.sub("", t).encode()).hexdigest()].append(k)
    expected = {}
    for digest, members in groups.items():
        keep = min(members, key=lambda k: (-len(texts[k]), k))
        expected |= {k: (keep, len(members), k == keep, digest) for k in members}
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(spark, "op5_exact_dedup")}
    assert found == expected


def test_hilbert_shards(spark, texts):
    found = rows(spark, "op6_hilbert_shards")
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found} == {
        k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items()
    }
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secret_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(re.sub("^\\(", "(?P<w>", ASSIGN), text, re.I | re.A) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def digest_of(spans):
    text = ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)
    return hashlib.sha256(text.encode()).hexdigest(), text


def test_secret_scan(spark, texts):
    for r in rows(spark, "op7_secret_scan"):
        spans = secret_spans(texts[r["doc_id"]])
        counts = Counter(kind for kind, _, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert (r["base_sha256"], r["spans"]) == digest_of(spans)


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def pii_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return found


def test_pii(spark, texts):
    total = Counter()
    for r in rows(spark, "op8_pii"):
        spans = pii_spans(texts[r["doc_id"]])
        counts = Counter(kind for kind, _, _ in spans)
        total += counts
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        base = ",".join(s for s in r["spans"].split(",") if not s.startswith("iban"))
        assert (r["base_sha256"], base) == digest_of(spans)
    assert len(total) >= 3


def test_packing(spark, texts, tokenizer):
    check_packing(rows(spark, "op10_packing"), texts, tokenizer)


def check_packing(found, texts, tokenizer):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for k, own in pieces.items():
        ids = ids_of(tokenizer, texts[k], 2)
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [(0, first), *((a, a + 1024) for a in range(first, len(ids), 1024))]
        assert sorted(own) == [(p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(cuts)]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-total // 1024)
    assert least <= len(places) <= least * 1.02 + 1


def test_quality_against_labels(spark):
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    found = queries.op9_quality(spark, "/root/testdata/sf0.01").collect()
    judged = [(labels[r["doc_id"]], r["kept"]) for r in found if r["doc_id"] in labels]
    good = [kept for quality, kept in judged if quality == 1]
    bad = [kept for quality, kept in judged if quality == 0]
    assert np.mean(good) >= 0.99
    assert np.mean(bad) <= 0.1


def test_decontamination_finds_copies(spark):
    sf = "/root/testdata/sf0.01"
    words = lambda t: re.findall(r"\w+", t.lower())
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    expected = {(d, i) for d, t in docs for i, s in items if f" {' '.join(words(s))} " in f" {' '.join(words(t))} "}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontaminate(spark, sf).collect()}
    assert expected and found == expected


def test_pipeline(spark, texts, tokenizer):
    """Later stages judged on the ids each keeps, by plain Python over what the first one keeps."""
    from peneira.llm import quality
    from peneira.llm.common import table

    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in quality.keep_good(docs).select("doc_id").collect()}
    best = {}
    for k in sorted(kept, key=lambda k: (-len(texts[k]), k)):
        best.setdefault(BLANK.sub("", texts[k]), k)
    left = sorted(best.values())
    fps = {k: _simhash(texts[k]) for k in left}
    classes = {}
    for k in left:
        joined = [c for c in classes if any((fps[k] ^ fps[m]).bit_count() <= 4 for m in classes[c])]
        members = [k, *(m for c in joined for m in classes.pop(c))]
        classes[min(members)] = members
    leaks = {r["doc_id"] for r in queries.op2_decontaminate(spark, SF).collect()}
    left = {k: texts[k] for k in classes if k not in leaks}
    check_packing([r.asDict() for r in corpus_pipeline.run(spark, SF).collect()], left, tokenizer)
