"""The registered queries that SQL cannot express, on whole small tables against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex

import corpus_pipeline
from sieveline.llm import language_id, toxicity
from sieveline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op7_is_the_library(spark, documents):
    t = tokenizer("word_bpe_49k.json")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_bpe"](spark, SF).collect()}
    want = {}
    for i, d in documents.items():
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        want[i] = len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())
    assert got == want


def test_op10_packs_every_id_once(spark, documents):
    t = tokenizer("byte_bpe_50k.json")
    ids = {i: np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4") for i, d in documents.items()}
    pieces, sequences = {}, {}
    for r in QUERIES["op10_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, all_ids in ids.items():
        assert [s for s, _ in sorted(pieces[i])] == [0, *np.cumsum([n for _, n in sorted(pieces[i])])[:-1]] and sum(n for _, n in pieces[i]) == len(all_ids)
    padding = 0
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and total <= 2048 and len(parts) <= 256
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_op4_is_a_plain_sum_over_segmentations(spark, documents):
    letters, order = regex.compile(r"\p{L}[\p{L}\p{M}]*"), sorted({d.lang for d in documents.values() if d.lang})
    runs = {i: ["▁" + x for w in WORD.findall(d.text or "") for x in letters.findall(w.lower())] for i, d in documents.items()}
    sample = [i for i, d in documents.items() if d.lang and not held_out(i)]
    assert len(sample) <= language_id.PER_LANGUAGE  # so that the fit reads them all
    counts = {}
    for i in sample:
        for x in runs[i]:
            counts.setdefault(x, np.zeros(len(order)))[order.index(documents[i].lang)] += 1
    pieces = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    p = language_id.fit({k: counts[k] for k in sorted(counts)}, pieces)
    prob, longest, known = dict(zip(pieces, p, strict=True)), max(map(len, pieces)), {}

    def logs(x):
        if x not in known:
            sums, scale = [np.ones(len(order))], 0.0
            for j in range(1, len(x) + 1):
                sums.append(sum(sums[i] * (prob[x[i:j]] if x[i:j] in prob else language_id.FLOOR) for i in range(max(0, j - longest), j) if x[i:j] in prob or j - i == 1))
                if j % 10 == 0 and sums[-1].max() < 1e-100:
                    sums, scale = [s * 1e100 for s in sums], scale - math.log(1e100)
            known[x] = np.log(sums[-1]) + scale
        return known[x]

    for r in QUERIES["op4_language_id"](spark, SF).collect():
        assert r.held_out == held_out(r.doc_id)
        if not runs[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(logs(x) for x in runs[r.doc_id])
        odds = np.exp(total - total.max())
        assert r.lang_pred == order[int(total.argmax())] and r.score == pytest.approx(odds.max() / odds.sum(), abs=1e-4)


def test_op5_is_one_row_at_a_time(spark, documents):
    told = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect():
        told[r.doc_id] = max(r.toxic, told.get(r.doc_id, 0))
    sample = sorted((i for i in told if i in documents and not held_out(i)), key=lambda i: (zlib.crc32(str(i).encode()), i))
    model = toxicity.fit([(documents[i].text, documents[i].lang or "", int(told[i] > 0)) for i in sample])
    for r in QUERIES["op5_toxicity"](spark, SF).collect():
        w = WORD.findall(documents[r.doc_id].text or "")
        p, guess = toxicity.score_rows(model, model.word_rows(w).astype(np.float32).reshape(len(w), -1), np.array([0, len(w)]))
        want = float(toxicity.rescale(p, model.thresholds[guess])[0])
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).selectExpr("*", "'x' as id", "'y' as row", "'z' as c0", "'w' as block", "'v' as score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert out.count() > 0 and (name == "packing" or out.columns == odd.columns), name


def test_run_leaves_only_its_result(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    import pathlib

    before = {p.name for p in pathlib.Path(folder).iterdir()} if pathlib.Path(folder).exists() else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {p.name for p in pathlib.Path(folder).iterdir()} - before
    assert len(left) == 1 and next(iter(left)).endswith("-packing")
