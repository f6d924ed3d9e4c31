import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import langid, licenses, packing, queries, sentencepieces, toxicity
from tallyspark.llm.common import stage_table
from tests.conftest import SF
from tests.llm.helpers import docs, texts
from tests.oracle import connect, same

BPE, PIECES = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "\n x\n\ny z ", "x y z", " a b", "é à\tb c", "日本語 テキスト", "<|endoftext|> a", "it's a's 's b", "a\r\n b", "a b c", "1 2 3 .. !! \x1c b", "a\x1c b", "x " * 50]


def test_license_scan_equals_sql(spark):
    same(queries.op2_license_scan(spark, SF), connect(SF), queries.oracle_sql()["op2_license_scan"])


def test_license_scan_by_brute_force(spark):
    rows = [*texts(), *licenses.TEMPLATES.values(), licenses.TEMPLATES["Zlib"].replace("software", "tool"), licenses.TEMPLATES["MIT-text"], "x\nReleased under the MIT License.\ny", "released UNDER the mit\tlicence", licenses.TEMPLATES["Apache-2.0-header"].replace("software", "programs")]

    def dice(text):
        best = (0.0, None)
        own = set(licenses.template_bigrams(text))
        for name in sorted(licenses.TEMPLATES):
            t = set(licenses.template_bigrams(licenses.TEMPLATES[name]))
            d = 2 * len(own & t) / (len(own) + len(t)) if own else 0
            if own and 200 * len(own & t) >= licenses.THRESHOLD * (len(own) + len(t)) and d > best[0]:
                best = (d, name)
        return best

    # units that miss as many words as may be missed
    rows += [" ".join(w for j, w in enumerate(t.split()) if j % 7 != i % 7) for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [rows[-1], rows[-1]]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        lines = [dice(x) for x in (t or "").split("\n")]
        assert got[i].license_lines == sum(1 for x in lines if x[1])
        assert got[i].line_license == max(lines, key=lambda x: x[0])[1]
        assert got[i].text_license == dice((t or "").replace("\n", " "))[1]
    assert licenses.scan(docs(spark, [])).count() == 0
    plan = licenses.scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    own, whole = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True
    for t in [*ODD, *(t for t in texts() if t)]:
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids


def check_packing(rows, lengths, size):
    """Pieces cover documents without gap or overlap, sequences are gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, n in lengths.items():
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == n
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert all(r.length == size for r in own[1:]) and (n > size or len(own) == 1)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_seq)


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    rows = [*texts(), *[f"text number {i} " * (i % 40) for i in range(200)]]
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(rows)}
    df = packing.packing_report(docs(spark, rows), BPE, lambda d: stage_table(d, "pieces")[0], size=256, shard=50)
    got = df.collect()
    used = check_packing(got, {i: len(x) for i, x in ids.items()}, 256)
    assert used <= 1.02 * sum(map(len, ids.values())) / 256 + 8
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert packing.packing_report(docs(spark, []), BPE, lambda d: stage_table(d, "pieces")[0]).count() == 0


def test_places_by_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 50, 300))[::-1]
    bins, offsets = packing.place(lengths, 50)
    free, count, order = {}, [0] * 51, []
    for n in lengths.tolist():
        fits = [g for g in range(n, 51) if count[g]]
        cost = {g: -2 * count[g] + 1 + (2 * count[g - n] + 1 if g > n else 0) for g in fits}
        best = n if count[n] else min(fits, key=lambda g: (cost[g], g)) if fits else None
        if best is None:
            best, b = 50, len(free)
        else:
            count[best] -= 1
            b = max((x for x, (g, at) in free.items() if g == best), key=lambda x: free[x][1])
        free[b] = (best - n, len(order))
        order.append(50 - best)
        count[best - n] += best > n
    assert offsets.tolist() == order and bins.max() + 1 == len(free)


def brute_pieces(m):
    """The best sum of log-probabilities by trying all pieces that end at each position."""
    table = {p: (s, i) for i, (p, s, kind) in enumerate(m.pieces) if kind == sentencepieces.NORMAL}
    longest = max(map(len, table))

    def brute(text):
        steps = [(0.0, 0, [])]
        for e in range(1, len(text) + 1):
            found = [(steps[b][0] + table[text[b:e]][0], e - b, [table[text[b:e]][1]]) for b in range(max(0, e - longest), e) if text[b:e] in table]
            if text[e - 1] not in table:
                found.append((steps[e - 1][0] + m.unknown_score, 1, [m.bytes_at[b] for b in text[e - 1].encode()]))
            steps.append(max(found, key=lambda x: x[:2]))
        out, at = [], len(text)
        while at:
            out.append(steps[at][2])
            at -= steps[at][1]
        return [i for own in reversed(out) for i in own]

    return brute


def test_ranks_become_log_probabilities():
    m = sentencepieces.load_model(PIECES)
    own = [s for _, s, kind in m.pieces if kind == sentencepieces.NORMAL]
    ranked = [s for s in own if s > -20]  # the file puts a few pieces beyond all ranks
    assert abs(sum(np.exp(own)) - 1) < 1e-5 and ranked == sorted(ranked, reverse=True) and len(ranked) > len(own) - 20


def test_piece_query_equals_brute_force(spark):
    m = sentencepieces.load_model(PIECES)
    brute = brute_pieces(m)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, SF).collect()}
    assert got.keys() == text.keys() and all(r.round_trip for r in got.values())
    for i in sorted(text)[::5]:  # the brute force is slow
        ids = brute(m.normal(text[i]))
        assert (got[i].n_pieces, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].n_byte_pieces == sum(m.pieces[x][2] == sentencepieces.BYTE for x in ids)


def test_pieces_by_brute_force():
    m = sentencepieces.load_model(PIECES)
    whole = brute_pieces(m)
    table = {p: (s, i) for i, (p, s, kind) in enumerate(m.pieces) if kind == sentencepieces.NORMAL}

    def brute(text):
        best = [(0.0, [])]
        for e in range(1, len(text) + 1):
            found = [(best[b][0] + table[text[b:e]][0], e - b, best[b][1] + [table[text[b:e]][1]]) for b in range(max(0, e - 48), e) if text[b:e] in table]
            if text[e - 1] not in table:
                found.append((best[e - 1][0] + m.unknown_score, 1, best[e - 1][1] + [m.bytes_at[b] for b in text[e - 1].encode()]))
            best.append(max(found, key=lambda x: x[:2])[::2])
        return best[-1][1]

    for t in [*ODD, *(t[:300] for t in texts() if t), "a 😀b  \U0010ffff", "▁x"]:
        ids = m.encode(t).tolist()
        assert ids == brute(m.normal(t)) == whole(m.normal(t))
        assert m.decode(ids) == t.replace("▁", " ") or t.startswith("▁")


def test_piece_report(spark):
    got = {r.doc_id: r for r in sentencepieces.piece_report(docs(spark), PIECES).collect()}
    assert all(r.round_trip for r in got.values()) and got[0].n_pieces == got[1].n_pieces == 0
    encoded = sentencepieces.encode(docs(spark), PIECES)
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, PIECES).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}
    assert sentencepieces.piece_report(docs(spark, []), PIECES).count() == 0


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in rows.values() if r.held_out]
    assert len(rows) == len(langs) and {r.doc_id for r in out} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) > 0.95
    assert np.mean([r.rejected for r in rows.values()]) < 0.02


def test_language_query_by_brute_force(spark):
    """Every block with every dictionary, and the smallest sum."""
    import zstandard

    df = spark.read.parquet(f"{SF}/documents.parquet")
    learned = langid.dictionaries(df, ~langid.held_out(F.col("doc_id")))
    with_dict = lambda d: zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    sizes = lambda raw, d: sum(len(zstandard.ZstdDecompressor(dict_data=with_dict(d)).decompress(x, max_output_size=langid.BLOCK)) for x in raw)
    text = {r.doc_id: r.text for r in df.collect()}
    own = langid.Identifier(learned)
    for r in queries.op5_language_id(spark, SF).collect():
        t = text[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        size = dict(zip(own.names, own.sizes(t)))
        best = min(own.names, key=lambda n: (size[n], n))
        assert r.lang_pred == best and abs(r.score - 1 / sum(2.0 ** (-langid.TRUST * min(s - size[best], 2000)) for s in size.values())) < 1e-12
        assert r.rejected == any(s < (1 + langid.MARGIN) * size[best] for n, s in size.items() if n != best)
    # blocks cover a text to its end, and each is read back with its language's dictionary alone
    raw = ("Ein langer Text " * 700).lower().encode()
    blocks = [raw[i : i + langid.BLOCK] for i in range(0, len(raw), langid.BLOCK)]
    for n, pack, size in zip(own.names, own.packers, own.sizes(raw.decode())):
        packed = [pack(b) for b in blocks]
        assert sum(map(len, packed)) == size and sizes(packed, learned[n]) == len(raw)


def test_training_rows_are_whole_and_bounded(spark):
    """No text is cut, and what is learned from does not grow with the table."""
    rows = [(i, f"word{i} " * (1 + i % 400), "aa") for i in range(600)] + [(5, "word5 twice", "aa"), (None, "no id " * 9, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.dictionaries(df)["aa"].decode()
    kept = learned.split("\n")
    assert len(kept) <= langid.SAMPLE and set(kept) <= {t.lower() for _, t, _ in rows} and all(langid.SHORT <= len(t) <= langid.LONG for t in kept)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(600)] + [(5, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.training_rows(df.unionByName(df), marks, sample=100)
    assert len(found) <= 100 and {t for t, _ in found} <= {t for _, t, _ in rows}


def test_queries_on_empty_tables(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name


def test_language_cases(spark):
    learned = {"aa": b"lorem ipsum dolor sit amet " * 20, "bb": b"zwei drei vier acht neun " * 20}
    got = {r.doc_id: r for r in langid.identify(docs(spark, [*texts(), "lorem ipsum dolor sit amet", "zwei drei vier"]), learned).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 15)] == ["und"] * 4 and got[0].rejected and got[0].score == 0
    assert got[17].lang_pred == "aa" and got[18].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs(spark), {}).collect()} == {"und"}
    assert langid.dictionaries(docs(spark).withColumn("lang", F.lit(None).cast("string"))) == {}


def test_toxicity_generalises_to_misspellings():
    rng = np.random.default_rng(2)
    clean = [" ".join(f"w{rng.integers(60)}" for _ in range(60)) for _ in range(300)]
    bad = [" ".join(t.split()[:20] + [["horrid", "vile", "nasty"][i % 3]] + t.split()[21:]) for i, t in enumerate(clean[:150])]
    model = toxicity.train(bad + clean[150:], [1] * 150 + [0] * 150)
    found = model.scores([clean[200], clean[10] + " horrid", clean[11] + " horridd", "", "!!"])
    assert found[0] < 0.3 and found[1] > 0.7 and found[2] > 0.5 and found[3] == found[4] == 0
    again = toxicity.Model.unpack(model.pack())
    assert abs(again.scores([bad[0]])[0] - model.scores([bad[0]])[0]) < 1e-3
    assert toxicity.train(clean, [0] * 300).scores(clean[:2]).tolist() == [0, 0]
    # windows over many texts at once give what each alone gives
    assert np.allclose(model.scores(bad[:5]), [model.scores([t])[0] for t in bad[:5]])


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, "/root/testdata/sf0.01").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    own = [(r.score, label[i]) for i, r in rows.items() if r.held_out and i in label]
    clean = [s for s, y in own if not y]
    assert np.mean([s > c for s, y in own if y for c in clean]) > 0.85 and np.mean([c >= 0.7 for c in clean]) < 0.05


def test_toxicity_query_by_brute_force(spark):
    """Each text's worst window, by plain loops over windows, words and subwords."""
    df, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.training_rows(df, marks, ~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    model = toxicity.Model.unpack(model.pack())
    place = [int(x) for x in toxicity._PLACE]
    full = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    def rows_of(word):
        code = [ord(c) for c in f"<{word}>"]
        whole = sum(c * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(code)) & full
        grams = [(sum(code[a + i] * place[i] for i in range(n)) + n) & full for n in (3, 4, 5) for a in range(len(code) - n + 1)]
        return [mix(x) % toxicity.BUCKETS for x in [whole, *grams]]

    def score(text):
        words = toxicity.words_of(text)
        spans = [words[a : a + 4] for a in range(0, max(len(words) - 4, 0), 2)] + [words[-4:]] if words else []
        bags = [[r for w in span for r in rows_of(w)] for span in spans]
        return max((1 / (1 + np.exp(-(np.mean(model.table[b], axis=0) @ model.weights + model.bias))) for b in bags), default=0.0)

    text = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}
    assert got.keys() == text.keys() and all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    for i in sorted(text, key=lambda i: len(text[i]))[::6][:25]:
        assert abs(score(text[i]) - got[i].score) < 1e-4


def test_repeated_rows_and_columns(spark):
    """Equal rows get equal results, one each, whatever else the table has."""
    text = "Released under the MIT License.\nsome more words"
    names = ["doc_id", "text", "norm", "lines", "whole", "key", "ids", "batch", "copy"]
    df = spark.createDataFrame([(1, text, *range(7)), (1, text, *range(7)), (2, None, *range(7))], names)
    model = toxicity.train(["bad word here", "fine words there"] * 4, [1, 0] * 4, least_steps=20)
    learned = {"aa": b"lorem ipsum dolor sit amet " * 20, "bb": b"zwei drei vier acht neun " * 20}
    for out in (licenses.scan(df), langid.identify(df, learned), sentencepieces.piece_report(df, PIECES), toxicity.score(df, model)):
        rows = [tuple(r) for r in out.orderBy("doc_id").collect()]
        assert len(rows) == 3 and rows[0] == rows[1] and rows[2][0] == 2
    packed = packing.packing_report(df, BPE, lambda d: stage_table(d, "pieces")[0]).orderBy("offset").collect()
    assert len(packed) == 3 and len({r.offset for r in packed}) == 3


def test_full_pieces_have_sequences_of_their_own(spark):
    df = spark.createDataFrame([(1, "a " * 700)] * 3, "doc_id long, text string")
    got = packing.packing_report(df, BPE, lambda d: stage_table(d, "pieces")[0], size=64).where("length = 64").collect()
    assert len(got) == len({r.sequence_id for r in got}) > 6


def test_toxicity_cases(spark):
    model = toxicity.train(["bad word here", "fine words there"] * 4, [1, 0] * 4, least_steps=20)
    got = toxicity.score(docs(spark), model).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(docs(spark), none) == []
