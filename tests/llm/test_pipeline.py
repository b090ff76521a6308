"""Each stage of the pipeline, and its run, against plain versions on a small table."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sieveline.llm import toxicity

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def toxic(rows, labels):
    """Fit on the labelled rows that are not held out, then score one row at a time."""
    told = {}
    for r in labels:
        if r["toxic"] is not None:
            told[r["doc_id"]] = max(r["toxic"], told.get(r["doc_id"], 0))
    sample = sorted((r["doc_id"], r["text"], r["lang"]) for r in rows if r["doc_id"] in told and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    assert all(sum((told[i] > 0) == k for i, *_ in sample) <= toxicity.PER_LABEL for k in (0, 1))
    sample.sort(key=lambda x: zlib.crc32(str(x[0]).encode()))
    model = toxicity.fit([(t, lang or "", int(told[i] > 0)) for i, t, lang in sample])
    kept = []
    for r in rows:
        w = words(r["text"])
        p, guess = toxicity.score_rows(model, model.word_rows(w).astype(np.float32), np.array([0, len(w)]))
        if toxicity.rescale(p, model.thresholds[guess])[0] < toxicity.THRESHOLD:
            kept.append(r)
    return kept


def exact(rows):
    seen = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        seen.setdefault(re.sub(SPACE, " ", r["text"] or ""), r)
    return list(seen.values())


def near(rows):
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append(set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return [r for i, r in enumerate(rows) if least[find(i)] == r["doc_id"]]


def cut(rows):
    first, out = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = words(r["text"])
        grams = [tuple(w[p : p + 13]) for p in range(len(w) - 12)]
        gone = {p + j for p, g in enumerate(grams) if first.setdefault(g, r["doc_id"]) != r["doc_id"] for j in range(13)}
        if not gone:
            out.append(r)
        elif len(gone) < len(w):
            text = " ".join(x for p, x in enumerate(w) if p not in gone)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def same(got, want):
    key = lambda r: tuple(sorted((k, repr(v)) for k, v in r.items()))
    assert sorted(map(key, got)) == sorted(map(key, want))


def packed(got, want):
    """Every token of every text once, in full sequences within the limits."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tokens = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], np.uint32).tobytes() for r in want}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == tokens
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) <= 2048 and len(parts) <= 256


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return read("documents"), [r.asDict() for r in read("documents").collect()], [r.asDict() for r in read("labels").collect()]


def test_each_stage_and_the_run_are_brute_force(spark, tables):
    docs, rows, labels = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    for name, plain in (("toxicity", lambda x: toxic(x, labels)), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", cut)):
        before, out, rows = rows, stages[name](spark, docs, SF), plain(rows)
        same([r.asDict() for r in out.collect()], rows)
        assert rows and rows != before, name
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    packed([r.asDict() for r in stages["packing"](spark, docs, SF).collect()], rows)
    packed([r.asDict() for r in corpus_pipeline.run(spark, SF).collect()], rows)
