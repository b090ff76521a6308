"""Edge cases and brute-force versions of the training-data operators."""

import hashlib
import pathlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import bpe, common, exact_dedup, kernels, language_id, licenses, minhash, packing, substring_dedup, suffix_dedup, topk, toxicity
from sieveline.llm.wordcache import WordCache
from sieveline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, id string, row string, n string, lang string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


BASE = words(120, 1)
ROWS = [
    (1, BASE), (2, BASE.replace(" ", "\n ", 3)), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "One  two"), (8, "x" * 5000),
    (9, words(60, 2) + " " + " ".join(BASE.split()[20:90]) + " " + words(60, 3)), (10, BASE + " tail"), (None, "no id"), (12, "é ÉÀ ß 　x"), (8, "x" * 5000), (13, words(30000, 4)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "clash", "clash", "clash", ["en", "de"][(a or 0) % 2]) for a, b in ROWS], DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, matches, name):
    rows = matches(QUERIES[name](spark, SF), ORACLE_SQL[name])
    assert rows and (name != "op3_licenses" or any(r[-1] for r in rows))


def test_exact_dedup_edges(spark, docs, none):
    rows = exact_dedup.assign(docs).collect()
    assert len(rows) == len(ROWS) and exact_dedup.assign(none).count() == 0
    by_id = {r.id: r for r in rows}
    assert by_id[2].keep_id == 1 and by_id[4].keep_id == 3 and by_id[5].keep_id == 5 and by_id[8].group_size == 2
    assert exact_dedup.distinct_documents(docs).count() == len({r.digest for r in rows})


def test_index_persists(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.assign(docs, index)
    before = index.read().count()
    index.deregister()
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    later = spark.createDataFrame([(0, BASE), (99, "new text")], "doc_id long, text string")
    found = {r.id: r.keep_id for r in exact_dedup.assign(later, again).collect()}
    assert found == {0: 1, 99: 99} and again.read().count() == before + 1


def test_index_keeps_its_bucket_count(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"{common.shared_dir(spark)}/index-of-four", 4)
    exact_dedup.assign(rows, index)
    index.deregister()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 4 and exact_dedup.assign(rows, again).count() == 50 and again.read().count() == 50
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, 3)


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


def test_minhash_is_brute_force(spark, docs, none):
    rng = random.Random(5)
    rows = [(i, t) for i, t in ROWS if i is not None and (i, t) != ROWS[12]]
    for i in range(40):  # a group of near copies around the threshold, all different
        w = BASE.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((100 + i, " ".join(w)))
    sets, label = brute_components(rows, 3, 85)
    least = {x: min(r[0] for r, y in zip(rows, label, strict=True) if y == x) for x in label}
    want = sorted((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, label, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, shingle=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert minhash.near_duplicates(docs).count() == len(ROWS) and minhash.near_duplicates(none).count() == 0


def test_substring_dedup_edges(spark, docs, none):
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, carry=["id"]).collect()}
    assert rows[1].n_removed == 0 and rows[2].n_removed == 120 and rows[9].n_removed == 70 and rows[10].n_removed == 120 and rows[10].kept_text == "tail"
    assert rows[3].n_words == 0 and rows[8].n_removed == 0 and rows[13].n_words == 30000
    (factor,) = rows[9].factors
    assert (factor.start, factor.n_words, factor.ref_id) == (60, 70, 1)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_finds_passages(spark, docs, none):
    rows = [(r.doc_id, r.start, r.n_words, r.ref_id) for r in suffix_dedup.repeats(docs).collect()]
    assert {r[0] for r in rows} == {2, 9, 10}
    assert any(r[0] == 9 and r[1] == 60 and r[2] == 70 for r in rows)
    assert suffix_dedup.repeats(none).count() == 0


def test_bpe_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = docs.unionByName(spark.createDataFrame([(50, "A <|endoftext|>b é it's 12\x85z", "", "", "", "")], DDL))
    rows = bpe.encode(df, path)
    for r, (_, text) in zip(sorted(rows.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted([*ROWS, (50, "A <|endoftext|>b é it's 12\x85z")], key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert sorted(x.decoded for x in bpe.decode(rows, path).collect()) == sorted(x.decoded for x in rows.collect())
    assert bpe.encode(none, path, digest=True).count() == 0


def test_packing_covers_every_id(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing.pack(docs, path).collect()
    want = sorted(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32).tobytes() for _, x in ROWS)
    pieces = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id is None, r.doc_id or 0, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    assert sum(len(x) for p in pieces.values() for _, x in p) == sum(map(len, want))
    assert b"".join(x for _, x in sorted(pieces[False, 13, max(k[2] for k in pieces)])) in want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and len(parts) <= 256
    assert packing.pack(none, path).count() == 0


def test_packing_limits():
    seen = []
    packer = packing.VectorPacker((100, 4, 30), lambda *x: seen.append(x), pool=16)
    rng = random.Random(2)
    for i in range(300):
        n = rng.randint(1, 250)
        packer.add(i, 0, n, rng.randint(0, n))
    packer.finish()
    by = {}
    for _, _, length, seq, _ in seen:
        by.setdefault(seq, []).append(length)
    assert all(sum(v) <= 100 for v in by.values())
    full = [s for s, v in by.items() if len(v) > 4]
    assert len(full) <= 1  # only the tail, which is cut into powers of two


def test_packing_pads_nothing_whatever_limit_binds():
    for limits, draw in (((2048, 256, 2048), lambda r: r.randint(1, 7)), ((2048, 16, 700), lambda r: r.choice([1, 3, 50, 900, 5000])), ((64, 3, 9), lambda r: r.randint(1, 9))):
        rng, seen, sizes = random.Random(1), [], {}
        packer = packing.VectorPacker(limits, lambda *x: seen.append(x))
        for i in range(4000):
            sizes[i] = draw(rng)
            packer.add(i, 0, sizes[i], rng.randint(0, sizes[i]))
        packer.finish()
        sequences, pieces = {}, {}
        for key, start, length, sequence, offset in seen:
            sequences.setdefault(sequence, []).append((offset, length))
            pieces.setdefault(key, []).append((start, length))
        for parts in [*sequences.values(), *pieces.values()]:
            parts.sort()
            assert [x for x, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert {k: sum(n for _, n in v) for k, v in pieces.items()} == sizes
        totals = [sum(n for _, n in v) for v in sequences.values()]
        assert all(t == limits[0] or t & (t - 1) == 0 for t in totals) and max(map(len, sequences.values())) <= limits[1]


def brute_top_k(v, k=20):
    """(query, rank, id, score) of rows (id, vector); zeros pad the shorter, the smallest vector of an id asks."""
    rows = [(i, np.floor(64 * np.array([*x, *[0.0] * (24 - len(x))]))) for i, x in v if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    asks = {}
    for i, x in rows:
        if i % 20 == 0 and (i not in asks or tuple(x) < tuple(asks[i])):
            asks[i] = x
    out = []
    for q, x in asks.items():
        best = sorted((-int(x @ y), i) for i, y in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vec = lambda n=16: [float(x) for x in rng.normal(0, 0.2, n)]
    v = [(i, vec()) for i in range(300)]
    v += [(400, None), (420, [float("nan")] * 16), (440, [None] * 16), (None, [0.1] * 16), (460, [0.1] * 16), (461, [0.1] * 16)]
    v += [(480, vec()), (480, vec()), (480, vec()), (481, []), (482, vec(24)), (500, vec(3)), (-20, vec()), (301, v[7][1]), (301, v[7][1])]
    ddl = "vec_id long, embedding array<double>, id string, v string, slot string, score string"
    df = spark.createDataFrame([(*x, "clash", "clash", "clash", "clash") for x in v], ddl)
    asks = F.col("vec_id") % 20 == 0
    got = lambda d, **kw: sorted(map(tuple, topk.top_k(d, asks, **kw).collect()))
    want = brute_top_k(v)
    assert got(df) == want
    # many cells, and cells of several slots where a third of all rows are equal
    monkeypatch.setattr(topk, "SLOT", (16, 16))
    monkeypatch.setattr(topk, "BLOCK", 8)
    v += [(1000 + i, v[3][1]) for i in range(200)]
    df = spark.createDataFrame([(*x, "clash", "clash", "clash", "clash") for x in v], ddl)
    assert got(df, pivots=8) == brute_top_k(v) and got(df.repartition(7), pivots=40) == brute_top_k(v)
    assert topk.top_k(df.where("false"), asks).collect() == [] and topk.top_k(df.where("vec_id = 3"), asks).collect() == []
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), asks)


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "abababab" * 3]
    p = np.array([[0.3, 0.1], [0.2, 0.2], [0.2, 0.3], [0.1, 0.1], [0.1, 0.1], [0.1, 0.2]])
    lattice = language_id.Lattice(pieces)

    def total(s, lang):  # of the first characters, in exact logarithms
        out = [0.0]
        for j in range(1, len(s) + 1):
            ends = [(out[j - len(x)] + np.log(q)) for x, q in zip(pieces, p[:, lang], strict=True) if s[:j].endswith(x)]
            out.append(np.logaddexp.reduce(ends))
        return out[-1]

    texts = ["abab", "baba", "aab", "ab" * 12, "ab" * 40, "ba" * 700, "abba" * 200 + "a"]
    seen = 0
    for part, edges in lattice.groups(texts):
        back, scale = language_id.forward(p, edges, back=True)
        for row, i in enumerate(part):
            for lang in (0, 1):
                want = total(texts[i], lang)
                assert language_id.log_probability(p, edges)[row, lang] == pytest.approx(want)
                assert np.log(back[0][row, lang]) + scale[0][row, lang] == pytest.approx(want)
                seen += 1
    assert seen == 14


def test_fit_counts_pieces_of_any_length():
    pieces = ["▁", "x", "y", "▁" + "xy" * 30]
    p = language_id.fit({"▁" + "xy" * 30: np.array([5.0, 0.0]), "▁" + "x" * 400: np.array([0.0, 1.0])}, pieces)
    assert p[3, 0] > 0.5 > p[3, 1] and np.allclose(p.sum(axis=0), 1)


def test_language_id_letters(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"), (3, "\u00bd \u00b2 \u2167 12 _", None), (4, "x" * 3000, None), (5, "e\u0301", None), (6, "\u65e5" * 5000, None)]
    rows += [(10 + i, ["the house and the garden", "das Haus und der Garten"][i % 2], ["en", "de"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, path).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and got[3].lang_pred == "und" and got[3].score == 0
    assert all(got[i].lang_pred in ("en", "de") and 0.5 <= got[i].score <= 1 for i in (4, 5, 6))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.orderBy(F.desc("doc_id")).coalesce(1), path).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_id_accuracy_and_edges(spark, docs, none):
    import duckdb

    path = public_tokenizers.path("piece_bpe_32k.model")
    truth = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    found = {r.doc_id: r for r in language_id.identify(docs, path).collect()}
    assert found[3].lang_pred == found[4].lang_pred == "und" and all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(none, path).count() == 0


def test_toxicity_accuracy_and_edges(spark, docs, none):
    import duckdb

    truth = dict(duckdb.sql("select doc_id, max(toxic) from '/root/testdata/sf0.1/labels.parquet' group by 1").fetchall())
    rows = [r for r in QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    assert right >= 0.95 * len(rows)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(docs, labels).collect()} == {0.0}
    assert toxicity.scores(none, labels).count() == 0


def test_toxicity_of_a_text_depends_on_it_alone(spark):
    import duckdb

    texts = duckdb.sql("select doc_id, text, lang, toxic from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) order by 1").fetchall()
    model = toxicity.fit([(t, x, y) for _, t, x, y in texts])
    cache = WordCache(model.word_rows, toxicity.DIM + model.by_lang.shape[1])

    def scored(some):
        data, offsets = kernels.text_buffer(pa.array(some, pa.string()))
        starts, ends, wo = kernels.words(data, offsets)
        p, guess = toxicity.score_rows(model, cache(data, starts, ends), wo)
        return list(zip(p.tolist(), guess.tolist(), strict=True))

    some = [t for _, t, _, _ in texts[:150]] + ["", None, "one", "ü"]
    alone = [scored([t])[0] for t in some]
    for order in (some, some[::-1]):
        got = scored(order) if order is some else scored(order)[::-1]
        assert all(abs(a[0] - b[0]) <= 1e-9 and a[1] == b[1] for a, b in zip(got, alone, strict=True))


def test_toxicity_learns_from_every_labelled_document(spark):
    import hashlib
    import zlib

    # 200 words mark toxic texts, each in some twenty of 4,000: 600 texts hold too few of each
    name = lambda x: "".join(chr(97 + b % 26) for b in hashlib.md5(x.encode()).digest()[:9])
    text = lambda i: " ".join([*(name(f"plain{(i * 31 + k * k) % 900}") for k in range(12)), name(f"{'bad' if i % 2 else 'good'}{i // 2 % 200}")])
    rows = [(i, text(i), ("en", "de", None)[i % 3], i % 2) for i in range(8000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert all(got[i].held_out == held(i) for i in got) and len(got) == len(rows)
    assert sum(got[i].predicted == y for i, _, _, y in rows if held(i)) >= 0.99 * sum(held(i) for i in got)
    model = toxicity.fit([(t, lang or "", y) for i, t, lang, y in rows[::-1] if not held(i)])
    for i in range(0, 8000, 160):
        w = rows[i][1].split()
        p, guess = toxicity.score_rows(model, model.word_rows(w).astype(np.float32), np.array([0, len(w)]))
        assert abs(got[i].score - toxicity.rescale(p, model.thresholds[guess])[0]) < 1e-6


def test_license_forms(spark, docs, none):
    isc, mit, bsd = (licenses.KNOWN[x] for x in ("ISC", "MIT", "BSD-2-Clause"))
    wrap = lambda t: "\n".join(textwrap.wrap(t, 75))
    wrapped = isc.replace("above copyright notice", "above\ncopyright notice")
    rows = [
        (1, "ISC License\n", None, ""), (2, "Copyright (c) 2020 A\n" + isc.replace("notice", "NOTICE").replace(", ", " , ") + "\n", "ISC", ""),
        (3, None, None, ""), (4, "Licensed under the MIT Licence", "MIT-notice", "MIT-notice"),
        (5, "MIT License\n\nCopyright (c) 2021 Jane Roe\n\n" + wrap(mit), "MIT", ""), (6, "ISC License\n\nCopyright 2004-2010 X Y <x@y.z>\n\n" + wrapped, "ISC", ""),
        (7, "BSD 2-Clause License\n\nCopyright (c) 2019, Jane Roe\nAll rights reserved.\n\n" + wrap(bsd.replace("1. ", "* ").replace("2. ", "* ")), "BSD-2-Clause", ""),
        (8, "Some prose.\nReleased under the MIT License.\nMore \u2018prose\u2019.\n  // SPDX-License-Identifier: Apache-2.0\r\nReleased under the MIT License.", None, "Apache-2.0-notice,MIT-notice"),
        (9, "licence licence licence", None, ""), (10, "Copyright holders of 2020", None, ""), (11, wrap(licenses.KNOWN["Unlicense"]), "Unlicense", ""), (12, wrap(mit) + " but", None, ""),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert [(r.doc_id, r.license_id, r.notices) for r in licenses.scan(df).orderBy("doc_id").collect()] == [(i, x, n) for i, _, x, n in rows]
    forms = df.where("doc_id in (9, 10)").select(licenses.canonical(F.col("text")).alias("c")).collect()
    assert {r.c for r in forms} == {"license license license", ""}
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0
    own = licenses.scan(df, known=[("own", "Licence  LICENSE, licence")]).where("is_license").collect()
    assert [(r.doc_id, r.license_id) for r in own] == [(9, "own")]


def test_license_files_of_this_machine(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(x, (folder / f).read_text()) for f, x in names.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence files here")
    df = spark.createDataFrame([(i, t.upper().replace("\n", "\r\n")) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert [r.license_id for r in licenses.scan(df).orderBy("doc_id").collect()] == [x for x, _ in rows]


def test_pipeline_stages_keep_columns(spark, docs):
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
    kept = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    assert 2 not in kept and kept[10] == "tail" and kept[1] == BASE and 3 in kept
    assert corpus_pipeline.run(spark, SF).count() > 0



def repeated_words(rows, n):
    """(id, word) of all words in n words that occur at an earlier (id, place)."""
    seen, out = {}, set()
    for i, text in sorted(rows):
        w = WORD.findall(text)
        for at in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[at : at + n]), (i, at)) != (i, at):
                out |= {(i, p) for p in range(at, at + n)}
    return out


def near_copies():
    """Groups of near copies with an edit every 60 or 30 words, and passages of 40-60 words among foreign ones."""
    rng, rows = random.Random(11), []
    for group, (copies, every) in enumerate([(20, 60), (20, 30), (100, 60), (100, 30)]):
        base = words(400, 50 + group).split()
        for _ in range(copies):
            rows.append((len(rows), " ".join(f"z{rng.random()}" if rng.random() < 1 / every else w for w in base)))
    shared = words(60, 90).split()
    for n in (60, 30, 50, 40, 41, 39, 48, 60):
        rows.append((len(rows), " ".join([*words(30, 100 + n + len(rows)).split(), *shared[:n], *words(30, 300 + len(rows)).split()])))
    rows.append((len(rows), " ".join(["same"] * 100)))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]


def test_suffix_dedup_is_brute_force_on_near_copies(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: WORD.findall(t) for i, t in rows}
    got = set()
    for r in suffix_dedup.repeats(df.repartition(5)).collect():
        got |= {(r.doc_id, p) for p in range(r.start, r.start + r.n_words)}
        first = slice(r.start, r.start + 40), slice(r.ref_start, r.ref_start + 40)
        assert texts[r.doc_id][first[0]] == texts[r.ref_id][first[1]] and (r.ref_id, r.ref_start) < (r.doc_id, r.start)
    want = repeated_words(rows, 40)
    assert got == want, f"{len(want - got)} of {len(want)} words are missing, {len(got - want)} are too many"


def test_suffix_dedup_key_is_24_words(spark):
    """A 40-word repeat must hold a kept suffix and 24 words after its start."""
    shared = words(40, 91)
    rows = [(i, f"{words(20 + i, 400 + i)} {shared} {words(30, 600 + i)}", i) for i in range(40)]
    assert suffix_dedup.MIN_WORDS - suffix_dedup.WINDOW + 1 >= 24
    df = spark.createDataFrame(rows, "id long, text string, row long")
    kept = {i: set() for i in range(40)}
    for r in suffix_dedup.suffixes(df, suffix_dedup.MIN_WORDS, suffix_dedup.WINDOW).collect():
        if 20 + r.id <= r.place <= 20 + r.id + 40 - 24:
            kept[r.id].add(r.place - 20 - r.id)
    assert set.intersection(*kept.values())


def test_substring_dedup_factors_stand_in_their_references(spark):
    w = words(14, 70).split()
    rows = [*near_copies(), (2000, " ".join([*w[:13], "apart", *w[1:]])), (2001, "x " + " ".join(w) + " y")]
    texts = {i: WORD.findall(t) for i, t in rows}
    first, want = {}, {}
    for i in sorted(texts):
        at = [tuple(texts[i][p : p + 13]) for p in range(len(texts[i]) - 12)]
        want[i] = {p + j for p, x in enumerate(at) if x in first for j in range(13)}
        first |= {x: i for x in at if x not in first}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in substring_dedup.remove_repeats(df).collect():
        covered = [p for f in r.factors for p in range(f.start, f.start + f.n_words)]
        assert covered == sorted(want[r.doc_id]) and r.n_removed == len(covered)
        for f in r.factors:
            span, ref = texts[r.doc_id][f.start : f.start + f.n_words], texts[f.ref_id]
            assert f.ref_id < r.doc_id and ref[f.ref_start : f.ref_start + f.n_words] == span
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.remove_repeats(df, digest=True).collect()}
    kept = {i: " ".join(x for p, x in enumerate(t) if p not in want[i]) for i, t in texts.items()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}


def test_substring_dedup_parse_takes_the_longest_match():
    place, ref, spot = np.array([0, 1, 2, 3, 4]), np.array([1, 1, 2, 3, 3]), np.array([7, 8, 90, 50, 51])
    got = substring_dedup._parse(place, np.zeros(5, np.int64), ref, spot, 3)
    assert [x.tolist() for x in got] == [[0, 4], [4, 3], [1, 3], [7, 51]]


def test_packing_keeps_the_loss_limit(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    by = {}
    for r in packing.pack(docs.coalesce(1), path, loss_tokens=512, with_ids=False).collect():
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 512
    told = docs.coalesce(1).withColumn("bears", F.when(F.col("doc_id") % 3 > 0, 40 * F.col("doc_id")))
    bears, n, by = {r.doc_id: r.bears for r in told.collect()}, 0, {}
    for r in packing.pack(told, path, loss_tokens=100, loss_col="bears", with_ids=False).collect():
        first = 0 if bears[r.doc_id] is None else max(0, r.doc_tokens - bears[r.doc_id])
        loss = max(0, r.start + r.length - max(r.start, first))
        by.setdefault(r.sequence_id, []).append((r.length, loss))
        n += r.length
    assert all(sum(x) <= 2048 and sum(y) <= 100 for x, y in (zip(*v, strict=True) for v in by.values()))
    assert n == sum(r.length for r in packing.pack(docs, path, with_ids=False).collect())


def test_packer_keeps_all_limits_at_its_end():
    for seed in range(20):
        rng, seen = random.Random(seed), {}
        packer = packing.VectorPacker((100, 4, 30), lambda key, start, length, seq, _: seen.setdefault(seq, []).append((length, max(0, start + length - max(start, key[0] - key[1])))), pool=16)
        for _ in range(rng.randint(1, 60)):
            n = rng.randint(1, 250)
            loss = rng.randint(0, n)
            packer.add((n, loss), 0, n, loss)
        packer.finish()
        for v in seen.values():
            assert sum(x for x, _ in v) <= 100 and len(v) <= 4 and sum(y for _, y in v) <= 30


def test_pipeline_packing_returns_ids(spark, docs):
    rows = corpus_pipeline.packing(spark, docs, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
