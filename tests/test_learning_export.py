import io
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyspark.operators import learning, payees
from tallyspark.sources import export, labels
from tallyspark.sources.documents import PasswordRequired, read_words

LABELS = "description string, direction string, category string, source string"


def label_rows():
    return [(f"zorp cafe number {i}", "dr", "Food", "seed") for i in range(12)] + [(f"blim petrol pump {i}", "dr", "Fuel", "user") for i in range(12)]


def test_learn_and_classify(spark, tmp_path):
    path = str(tmp_path / "feedback")
    model, n = learning.learn(spark, spark.createDataFrame(label_rows(), LABELS), path)
    assert n == 24 and labels.read_feedback(spark, path).count() == 24
    model, n = learning.learn(spark, spark.createDataFrame(label_rows()[:3], LABELS), path)
    assert n == 24  # equal rows replace each other
    learning.save(spark, model, str(tmp_path / "model"))
    again = learning.load(spark, str(tmp_path / "model"))
    rows = spark.createDataFrame([(1, "zorp cofe 7", 5.0), (2, "blim petrl pmp", 6.0), (3, "ATM CASH", 7.0)], "id int, description string, debit double")
    got = {r.id: (r.category, r.method) for r in learning.classify(rows, again, 0.5).collect()}
    assert got[3] == ("Cash Withdrawal (ATM)", "rule")
    assert got[1] == ("Food", "ml")
    assert learning.load(spark, str(tmp_path / "none")) is None
    # probabilities sum to 1, and both models say the same
    terms = learning.with_terms(rows.withColumn("direction", F.lit("dr")))
    one, two = ([r.probability for r in m.probabilities(terms).orderBy("id").collect()] for m in (model, again))
    assert one == two and all(abs(sum(p) - 1) < 1e-9 for p in one)


def test_bootstrap(spark, tmp_path):
    seed = "Description,Direction,Category\n" + "".join(f"{d},{w},{c}\n" for d, w, c, _ in label_rows())
    Path(tmp_path, "seed.csv").write_text(seed)
    model = learning.bootstrap(spark, str(tmp_path / "m"), str(tmp_path / "seed.csv"))
    again = learning.bootstrap(spark, str(tmp_path / "m"), str(tmp_path / "none.csv"))  # now it is read
    assert model.labels == again.labels == ["Food", "Fuel"] and (model.idf == again.idf).all()


def test_term_weights(spark):
    rows = learning.weighted(spark.createDataFrame([(1, Vectors.sparse(4, [0, 2], [1.0, 3.0])), (2, Vectors.sparse(4, [], []))], ["id", "tf"]), np.array([1.0, 2.0, 0.5, 1.0]))
    got = {r.id: r.features for r in rows.collect()}
    x = np.array([1.0, 0.5 * (1 + np.log(3))])
    assert np.allclose(got[1].values, x / np.linalg.norm(x)) and got[1].indices.tolist() == [0, 2] and len(got[2].values) == 0


def test_sigmoids_by_brute_force(spark):
    """Against a grid search of the smoothed log loss."""
    rng = np.random.default_rng(3)
    rows = [(0, int(y), [float(m), float(-m)]) for y, m in zip(rng.integers(0, 2, 80), rng.normal(0, 1, 80))]
    rows = [(p, y, [m[0] + (1.5 if y == 0 else 0), m[1]]) for p, y, m in rows]
    got = learning.fit_sigmoids(spark.createDataFrame(rows, "part int, label int, margins array<double>"), 2)[0]
    for c in (0, 1):
        m, y = np.array([r[2][c] for r in rows]), np.array([r[1] == c for r in rows])
        t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
        loss = lambda a, b: (np.logaddexp(0, a * m + b) - t * (a * m + b)).sum()
        assert loss(*got[c]) <= min(loss(a, b) for a in np.linspace(-4, 4, 81) for b in np.linspace(-3, 3, 61)) + 1e-6


def test_feedback_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "feedback")
    for n in (1, 2, 3):
        labels.replace_feedback(spark.createDataFrame(label_rows()[:n], LABELS), path)
    assert labels.read_feedback(spark, path).count() == 3 and sorted(p.name for p in Path(path).iterdir()) == ["v2", "v3"]
    Path(path, "v4").mkdir()  # a version whose writer died
    assert labels.read_feedback(spark, path).count() == 3
    labels.replace_feedback(labels.read_feedback(spark, path).limit(2), path)
    assert labels.read_feedback(spark, path).count() == 2 and sorted(p.name for p in Path(path).iterdir()) == ["v3", "v5"]


def test_seed_file(spark, tmp_path):
    Path(tmp_path, "seed.csv").write_text('Description,Direction,Category\n"A, B",dr,Food\nC,cr,Salary\n')
    assert sorted(tuple(r) for r in labels.read_seed(spark, str(tmp_path / "seed.csv")).collect()) == [("A, B", "dr", "Food", "seed"), ("C", "cr", "Salary", "seed")]
    Path(tmp_path, "bad.csv").write_text("Description,Category\nx,y\n")
    with pytest.raises(ValueError):
        labels.read_seed(spark, str(tmp_path / "bad.csv"))


def test_too_few_rows(spark):
    assert learning.train(spark.createDataFrame(label_rows()[:5], LABELS)) is None
    with pytest.raises(ValueError):
        learning.merge_feedback(spark.createDataFrame([], LABELS), spark.createDataFrame([("a",)], "description string"))


def test_payees(spark):
    rows = [("f", i, n) for i, n in enumerate(["Swiggy", "Swiggy", "Swigy", "", "Acme"])]
    df = spark.createDataFrame(rows, "source_file string, seq int, counterparty string")
    assert sorted(r.counterparty for r in payees.consolidate(df).collect()) == ["", "Acme", "Swiggy", "Swiggy", "Swiggy"]


@pytest.mark.parametrize("cutoff", [0.75, 0.6])
def test_payees_by_brute_force(spark, cutoff):
    """Against comparing all names of a file with each other, in order of their frequency."""
    import difflib
    import random

    rng = random.Random(5)
    names = [rng.choice(["Corner Shop", "Acme Stores", "Abc", "Xy Cafe", "Petrol Pump"]) for _ in range(60)]
    names = ["".join(c for c in n if rng.random() > 0.12) + rng.choice(["", "", " In", "x"]) for n in names] * 2 + ["ab", "abc", "a", "ba"]
    rows = [(f, i, n) for f in ("f", "g") for i, n in enumerate(names[(f == "g") * 40 :])]
    got = {(r.source_file, r.seq): r.counterparty for r in payees.consolidate(spark.createDataFrame(rows, "source_file string, seq int, counterparty string"), cutoff).collect()}
    for f in ("f", "g"):
        own = [n for g, _, n in rows if g == f]
        order = sorted({n for n in own if n}, key=lambda n: (-own.count(n), own.index(n)))
        led, left = {}, list(order)
        for n in order:
            if n in left:
                for other in difflib.get_close_matches(n, left, n=15, cutoff=cutoff):
                    led[other] = n
                    left.remove(other)
        assert [got[f, i] for i in range(len(own))] == [led.get(n, n) for n in own]


def test_csv_and_workbook(spark, tmp_path):
    from tallyspark.plans.fixtures import ledger
    from tests.conftest import SF

    rows = ledger(spark, SF).where("source_file = 'stmt_1'")
    raw = b"".join(export.csv_bytes(rows))
    assert raw.startswith(b"\xef\xbb\xbfDate,Description,Ref,Debit")
    assert raw.count(b"\n") == rows.count() + 1 and b" 00:00:00," in raw
    accounts = spark.createDataFrame([("stmt_1", "X & Co", 1234.5, "2024-04-01")], "file string, holder string, opening_balance double, period_from string")
    with zipfile.ZipFile(io.BytesIO(export.workbook(rows, accounts))) as z:
        assert z.testzip() is None
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, 5)]
    assert sheets[0].count("<row ") == rows.count() + 1 and "X &amp; Co" in sheets[3]
    import xml.dom.minidom

    for s in sheets:
        xml.dom.minidom.parseString(s)
    # money and days of the account have their formats, the day is a number
    assert f's="{export._style("none", "Opening Balance")}"><v>1234.5</v>' in sheets[3] and f's="{export._style("none", "Period From")}"><v>45383</v>' in sheets[3]
    n = rows.count()
    with zipfile.ZipFile(io.BytesIO(export.workbook(rows, accounts, 5))) as z:
        names = [x.attributes["name"].value for x in xml.dom.minidom.parseString(z.read("xl/workbook.xml")).getElementsByTagName("sheet")]
        own = [i for i, x in enumerate(names, 1) if x.startswith("Transactions")]
        assert len(own) == -(-n // 4) and sum(z.read(f"xl/worksheets/sheet{i}.xml").decode().count("<row ") - 1 for i in own) == n
    export.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == rows.count()


def test_bad_files_do_not_stop_a_job(spark, tmp_path):
    for name in ("a", "b", "c"):
        Path(tmp_path, f"{name}.pdf").write_bytes(name.encode())

    def extract(raw):
        if raw == b"b":
            raise PasswordRequired
        if raw == b"c":
            raise ValueError("broken")
        return [{"page": 1, "kind": "text", "word_no": 0, "text": "hi", "x0": 0.0, "x1": 1.0, "top": 0.0, "bottom": 1.0}]

    got = {r.source_file: r.status for r in read_words(spark, str(tmp_path), extract).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "password", "c.pdf": "broken"}


def test_stream_totals(spark, tmp_path):
    from tallyspark.streaming import ledger_stream

    schema = "at timestamp, description string, debit double, credit double"
    spark.sql("select timestamp'2024-01-01 10:00:00' as at, 'ATM CASH' as description, 5.0D as debit, cast(null as double) as credit").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = ledger_stream.daily_totals(ledger_stream.classified(stream)).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("totals").select("category", "debit", "transactions").collect()] == [("Cash Withdrawal (ATM)", 5.0, 1)]
