import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import ngram_join, oph
from tallyspark.llm.shingles import shingle_hashes, shingle_sets
from tests.conftest import SF
from tests.llm.helpers import components, docs, shingle_set, texts
from tests.oracle import connect


def test_shingles_equal_python_sets():
    raw = [(t or "").encode() for t in texts()]
    for k in (1, 4, 5):
        for t, own in zip(texts(), shingle_sets(raw, k)):
            assert len(own) == len(shingle_set(t, k))
    a, b = shingle_sets([b"A b\tc d e", b"a B c  d E"], 4)
    assert (a == b).all()
    hashes, at = shingle_hashes(raw, 4)
    assert at[-1] == len(hashes)


def test_fingerprint_likeness_is_near_jaccard():
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for cut in (0, 40, 200, 400):
        other = base[:-cut] + [f"v{i}" for i in range(cut)] if cut else base
        a, b = " ".join(base), " ".join(other)
        code, some = oph.codes([a.encode(), b.encode()])
        x, y = shingle_set(a, 5), shingle_set(b, 5)
        assert abs(float(oph.likeness(code[:1], some[:1], code[1:], some[1:])[0]) - len(x & y) / len(x | y)) < 0.09


def test_densification_by_brute_force():
    low, some = oph.minima([b"only six words are in here"], bins=16)
    hashes, _ = shingle_hashes([b"only six words are in here"], oph.WORDS)
    assert some[0] and set(low[0].tolist()) == set(hashes.tolist()) and len(low[0]) == 16
    code, some = oph.codes([b"", b"x y"])
    assert oph.pack(code, some)[0] == "" and oph.unpack(oph.pack(code, some))[0].tolist()[1] == code[1].tolist()


def brute_report(rows, key=lambda r: -r[0]):
    order = sorted(rows, key=key)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        yield i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()


def test_fingerprint_report(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in oph.fingerprint_report(docs(spark).repartition(5)).collect()}
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got.values()} == set(brute_report(rows))
    assert got[6].fingerprint == got[7].fingerprint == got[8].fingerprint and got[7].near_next == 1.0
    assert got[0].fingerprint == "" and got[1].near_next == 1.0 and got[3].near_next == 0.0
    assert oph.fingerprint_report(docs(spark, [])).count() == 0
    one = oph.fingerprint_report(docs(spark, ["alone in the world"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_report_with_null_and_equal_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c d"), (1, "c d"), (1, "b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_chars) for r in oph.fingerprint_report(df).collect()) == [(False, 1), (False, 3), (False, 3), (True, 3)]


def joined(df, k=4, percent=85):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df, k, percent).collect()}


def want(rows, k=4, percent=85):
    sets = {i: shingle_set(t, k) for i, t in rows}
    return {i: (len(sets[i]), c) for i, c in components(sets, percent).items()}


def test_a_common_id_is_cut(spark):
    rows = [(7, f"text {i} of many with the same id") for i in range(400)] + [(i, f"other {i}") for i in range(100, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = dict(df.select("text", F.xxhash64("text")).collect())
    found = oph.with_next(df, 8)
    parts = [r["count"] for r in found.where("not halo").groupBy("part").count().collect()]
    assert sum(parts) == 450 and max(parts) <= 120 and found.where("halo").groupBy("part").count().where("count > 1").count() == 0
    assert sorted(tuple(r)[:3] for r in oph.fingerprint_report(df).collect()) == sorted(brute_report(rows, lambda r: (-r[0], digest[r[1]])))


def test_join_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    assert joined(docs(spark)) == want(rows)
    assert ngram_join.link_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rare, percent, crowd", [(1, 85, 3), (1, 80, 64), (64, 85, 3)])
def test_join_of_edited_copies(spark, monkeypatch, rare, percent, crowd):
    """Groups of near copies around the threshold, a passage in many texts, and frequent tokens that need pairs."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "AGREED", 9 if rare == 1 else 4)  # without stars all links come from the index
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(40 + 40 * g)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append(w)
    rows += [passage + [f"u{i}_{j}" for j in range(rng.randrange(1, 30))] for i in range(30)]
    rng.shuffle(rows)
    rows = list(enumerate(" ".join(w) for w in rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(df, 4, percent) == want(rows, 4, percent)


def pool(texts, shared, keep, seed=4):
    """Texts drawn from one pool of shingles: alike, but (but for a few) not as much as the threshold asks for."""
    rng = np.random.default_rng(seed)
    rows = [" ".join(f"a{j} b{j} c{j} d{j}" for j in np.flatnonzero(rng.random(shared) < keep)) for _ in range(texts)]
    return rows + [rows[0] + " x y z", rows[1] + " u v"]


def test_crowded_signatures_meet_once(spark, monkeypatch):
    """In a pool of alike texts few pairs meet more than once, and none of those that link is lost."""
    made = []
    whole = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *args: made.append(whole(*args).count()) or whole(*args))
    monkeypatch.setattr(ngram_join, "CROWD", 16)
    rows = list(enumerate(pool(120, 150, 0.93)))
    assert joined(docs(spark, [t for _, t in rows])) == want(rows)
    assert made[0] <= 122


@pytest.mark.parametrize("groups, fan", [(False, 2), (True, 3), (True, 512)])
def test_frequencies_over_hops(spark, monkeypatch, groups, fan):
    """Blocks learn what a count over all rows says, however many hops their tokens take."""
    monkeypatch.setattr(ngram_join, "FAN", fan)
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 400, 60, dtype=np.uint64) * np.uint64(2**39 + 12345)) for _ in range(90)]
    rows = spark.createDataFrame([(i, i % 40, bytearray(ngram_join.to_bytes(x))) for i, x in enumerate(sets)], "cid long, grp long, tokens binary")

    def told(frame, tokens, count):
        import pandas as pd

        return pd.DataFrame([(c, bytes(ngram_join.to_bytes(ngram_join.from_bytes(t)[ngram_join.lookup(ngram_join.from_bytes(t), tokens, count, 0) > 1]))) for c, t in zip(frame["cid"], frame["tokens"])], columns=["cid", "shared"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("shared", T.BinaryType())])
    got = {r.cid: set(ngram_join.from_bytes(bytes(r.shared)).tolist()) for r in ngram_join.with_frequencies(rows, 11, groups, told, schema).collect()}
    owners = {}
    for i, x in enumerate(sets):
        for t in x.tolist():
            owners.setdefault(t, set()).add(i % 40 if groups else i)
    assert got == {i: {t for t in x.tolist() if len(owners[t]) > 1} for i, x in enumerate(sets)}


def test_masks_tell_leaders(spark):
    """Two entries of a signature without a common bit share none of its leaders, and each pair is kept apart or met."""
    rng = np.random.default_rng(6)
    sigs = {c: set(rng.choice(40, 12, replace=False).tolist()) for c in range(60)}
    count = {s: sum(s in x for x in sigs.values()) for s in range(40)}
    entries = spark.createDataFrame([(s, c, c, 50, 50, count[s]) for c, own in sigs.items() for s in own], "sig long, cid long, grp long, n long, cap long, m long")
    sets = spark.createDataFrame([(c, 50, 0, bytearray(b""), *[0] * 16) for c in sigs], ngram_join.SETS)  # all are plausible
    mask = {(r.sig, r.cid): r["mask"] for r in ngram_join.crowded(entries, sets).collect()}
    assert len(mask) == sum(map(len, sigs.values()))
    for a in sigs:
        for b in range(a + 1, 60):
            common = sigs[a] & sigs[b]
            if common:
                first = min(common, key=lambda s: (-count[s], s))
                assert mask[first, a] & mask[first, b] == 0
    found = ngram_join.candidates(entries.withColumn("m", entries.m + ngram_join.CROWD), sets, 85, ngram_join.stage_table)
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a in sigs for b in range(a + 1, 60) if sigs[a] & sigs[b]}


def test_prefixes_meet():
    """Any two sets that link share a signature, whatever frequencies say."""
    rng = np.random.default_rng(5)
    for k in range(200):
        n = int(rng.integers(1, 260) if k < 150 else rng.integers(260, 1500))
        tokens = np.unique(rng.integers(0, 2**48, n + 80, dtype=np.uint64))
        count = rng.choice([2, 3, 50, 200, 5000], len(tokens))
        x = np.sort(rng.choice(len(tokens), min(n, len(tokens)), replace=False))
        y = np.sort(np.concatenate((x[rng.random(len(x)) > 0.08], np.setdiff1d(np.arange(len(tokens)), x)[: int(rng.integers(0, 1 + n // 20))])))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= 85 * (len(x) + len(y) - common):
            a, _ = ngram_join.signatures(tokens[x], count[x], len(x), 85)
            b, _ = ngram_join.signatures(tokens[y], count[y], len(y), 85)
            assert len(np.intersect1d(a, b))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (3, 50, 900):
        x = np.unique(rng.integers(0, 2**48, n, dtype=np.uint64))
        for keep in (1.0, 0.95, 0.3):
            y = x[rng.random(len(x)) <= keep]
            differ = int(np.bitwise_count((ngram_join.parities(x) ^ ngram_join.parities(y)).view(np.uint64)).sum())
            assert differ <= len(x) - len(y) and (len(x) - len(y) > 20 or differ >= len(x) - len(y) - 4)


def test_components_of_paths_and_stars(spark):
    from tallyspark.llm.common import stage_table

    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(-5, -9)]
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long"), stage_table).collect()
    comp = {r.cid: r.comp for r in found}
    assert len(found) == 21 + 30 + 2 and {comp[i] for i in range(21)} == {0} and {comp[i] for i in range(100, 130)} == {100} and comp[-5] == comp[-9] == -9
    assert ngram_join.components(spark.createDataFrame([], "a long, b long"), stage_table).count() == 0


def test_join_null_and_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " x"), (9, "other words here now"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect())
    assert got == [(-1, 47, 7), (3, 0, 3), (7, 47, 7), (7, 47, 7), (9, 1, 9), (9, 48, 7)]


def test_query_equals_brute_force_on_documents(spark):
    from tallyspark.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard_join(spark, SF).collect()}
    assert got == want(rows)
    sql = connect(SF).execute(queries.oracle_sql()["op4_ngram_jaccard_join"])
    assert [d[0] for d in sql.description] == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: r[1:] for r in sql.fetchall()} == got
    report = {(r.doc_id, r.n_chars, r.edited_sha256) for r in queries.op1_fingerprints(spark, SF).collect()}
    assert report == set(brute_report(rows))
