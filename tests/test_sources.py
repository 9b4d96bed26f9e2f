import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from seriesloom.session import scratch_dir, scratch_scope
from seriesloom.sources import grid, payloads, quotes, store
from tests.helpers import day


def payload(spark, *documents):
    return spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in documents], "payload string")


def test_quote_sheet_file(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(
        "INDICADOR DO PREÇO;;\n;;\nFonte: X;;\nData;À vista R$;À vista US$\n"
        "23/07/1997;26.67;24,1\n24/07/1997;R$ 27,05;1\n25/07/1997;;1\n31/02/1997;28;1\n;29;1\n",
        encoding="utf-8",
    )
    raw = quotes.read_quote_sheet(spark, str(sheet))
    rows = quotes.parse_quotes(raw).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(dt.date(1997, 7, 23), 26.67), (dt.date(1997, 7, 24), 27.05)]


QUARTERLY = [
    {"D3C": "Trimestre (Código)", "D4N": "Referência", "D2N": "Variável", "V": "Valor"},
    {"D3C": "202001", "D4N": "No 1º mês", "D2N": "Animais abatidos", "V": "100"},
    {"D3C": "202001", "D4N": "No 1º mês", "D2N": "Número de cabeças", "V": "999"},
    {"D3C": "202001", "D4N": "No 2º mês", "D2N": "Animais abatidos", "V": "-"},
    {"D3C": "202002", "D4N": "No 3º mês", "D2N": "Peso total das carcaças", "V": "12,5"},
    {"D3C": "202002", "D4N": "No 3º mês", "D2N": "Outra coisa", "V": "1"},
    {"D3C": "202003", "D4N": None, "D2N": "Animais abatidos", "V": "..."},
]


def test_quarterly_json(spark):
    parsed = payloads.parse_quarterly(payload(spark, QUARTERLY))
    assert parsed.count() == 4
    wide = {r["month"]: (r["head_count"], r["weight"]) for r in payloads.pivot_quarterly(parsed).collect()}
    # Two labels stand for the head count; the first record of the response wins.
    assert wide == {dt.date(2020, 1, 1): (100.0, None), dt.date(2020, 6, 1): (None, 12.5)}


def test_quarterly_default_ordinal(spark):
    rows = [QUARTERLY[0], {"D3C": "202003", "D2N": "Animais abatidos", "V": "5"}]
    assert payloads.parse_quarterly(payload(spark, rows)).first()["month"] == dt.date(2020, 7, 1)


def test_quarterly_without_records_is_an_error(spark):
    with pytest.raises(Exception, match="empty or invalid"):
        payloads.parse_quarterly(payload(spark, QUARTERLY[:1])).collect()


def test_trade_json(spark):
    doc = {"data": {"list": [
        {"year": "2020", "monthNumber": "1", "heading": "0201", "metricFOB": "10.5", "metricKG": "2"},
        {"year": "2020", "monthNumber": "1", "heading": "0202", "metricFOB": "n/d", "metricKG": "3"},
    ]}}
    rows = payloads.parse_trade(payload(spark, doc, {"data": {"list": []}})).orderBy("heading").collect()
    assert [tuple(r) for r in rows] == [
        (dt.date(2020, 1, 1), "0201", 10.5, 2.0), (dt.date(2020, 1, 1), "0202", 0.0, 3.0),
    ]


def test_rate_and_inflation_json(spark):
    doc = {"value": [{"cotacaoVenda": 5.25, "dataHoraCotacao": "2020-01-02 13:09:02.5", "cotacaoCompra": 5.2}]}
    row = payloads.parse_rates(payload(spark, doc)).first()
    assert row["fx"] == 5.25 and row["ts"].date() == dt.date(2020, 1, 2)
    rows = payloads.parse_inflation(payload(spark, [{"data": "01/02/2020", "valor": "0.25"}, {"data": "01/03/2020", "valor": "x"}]))
    assert [tuple(r) for r in rows.orderBy("month").collect()] == [(dt.date(2020, 2, 1), 0.25), (dt.date(2020, 3, 1), None)]


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(QUARTERLY, ensure_ascii=False, indent=1), encoding="utf-8")
    assert payloads.parse_quarterly(payloads.read_payloads(spark, str(tmp_path))).count() == 4


def test_grid(spark):
    cells = [(day(0), 1.0, 1.0, 0.001, 1), (day(0), 1.0, 2.0, 0.003, 2), (day(0), 1.0, 2.0, 9.0, 3), (day(1), 1.0, 1.0, None, 4)]
    df = spark.createDataFrame(cells, "time date, latitude double, longitude double, tp double, n long")
    assert grid.grid_variable(["time", "lat", "x", "total_precip"]) == "total_precip"
    assert grid.grid_variable(["time", "x", "y"]) == "x"
    rows = {r["time"]: r["rain_mm"] for r in grid.grid_mean(df, order="n").collect()}
    assert rows[day(0)] == pytest.approx(2.0) and rows[day(1)] is None
    with pytest.raises(ValueError):
        grid.grid_variable(["time", "lat"])


def test_cache_reads_what_it_wrote(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("s", day(0), 1.0)], "series_id string, date date, v double")

    for use_cache in (True, True, False):
        assert store.cached_table(spark, path, compute, use_cache).count() == 1
    assert len(calls) == 2


def test_cache_survives_a_dead_write(spark, tmp_path):
    """A write that died leaves files without a pointer: they are neither read nor in the way."""
    path = str(tmp_path / "cache")
    row = lambda v: spark.createDataFrame([("s", day(0), v)], "series_id string, date date, v double")
    row(99.0).write.parquet(f"{path}/v-dead")
    assert store.published(spark, path) is None
    assert store.cached_table(spark, path, lambda: row(1.0)).first()["v"] == 1.0
    first = store.published(spark, path)

    def dies():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.cached_table(spark, path, dies, use_cache=False)
    assert store.published(spark, path) == first
    old = spark.read.parquet(first)
    assert store.cached_table(spark, path, lambda: row(2.0), use_cache=False).first()["v"] == 2.0
    assert old.first()["v"] == 1.0, "readers of the version before keep their files"
    with pytest.raises(FileNotFoundError):
        store.read_published(spark, str(tmp_path / "none"))


def test_scratch_scope_deletes_what_it_held(spark):
    with scratch_scope(spark, "job") as folder:
        out = store.cut_lineage(spark.range(3), "t")
        assert out.inputFiles()[0].startswith(f"file://{folder.removeprefix('file:')}") and out.count() == 3
        assert os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_statistics_take_the_first_response(spark, tmp_path):
    """Two responses with the same month: the first file counts, in whatever order they are read."""
    header = QUARTERLY[0]
    record = lambda v: {"D3C": "202001", "D4N": "No 1º mês", "D2N": "Peso total das carcaças", "V": v}
    for name, value in (("a.json", "10"), ("b.json", "20")):
        (tmp_path / name).write_text(json.dumps([header, record(value), record("5")], ensure_ascii=False), encoding="utf-8")
    both = payloads.read_payloads(spark, str(tmp_path))
    for responses in (both, both.orderBy("source"), both.orderBy(F.desc("source"))):
        wide = payloads.pivot_quarterly(payloads.parse_quarterly(responses)).collect()
        assert [r["weight"] for r in wide] == [10.0]


def test_placed_quote_lines(spark, tmp_path):
    for name, value in (("a.csv", "1,5"), ("b.csv", "2,5")):
        (tmp_path / name).write_text(f"01/02/2020;{value}\n01/02/2020;9\n02/02/2020;3\n", encoding="utf-8")
    rows = quotes.parse_quotes(quotes.read_quote_sheet(spark, str(tmp_path), placed=True))
    first = rows.groupBy("date").agg(F.min_by("quote", F.struct("source", "place")).alias("quote"))
    assert [r["quote"] for r in first.orderBy("date").collect()] == [1.5, 3.0]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1 + 0.2), ("b", None)], "k string, v double")
    store.write_csv(df, str(tmp_path / "c"))
    assert sorted(store.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == sorted(df.collect())
    store.write_json(df, str(tmp_path / "j"))
    assert store.read_json(spark, str(tmp_path / "j"), df.schema).count() == 2


class Session:
    """Just enough of a session to ask for a scratch folder."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_scratch_follows_the_session():
    session = Session("spark://host:7077", "hdfs:///shared/")
    first, second = scratch_dir(session, "x"), scratch_dir(session, "x")
    assert first.startswith("hdfs:///shared/x-") and first != second
    with pytest.raises(ValueError):
        scratch_dir(Session("spark://host:7077"), "x")
    local = Session("local[2]")
    assert scratch_dir(local, "x").startswith(f"{local.folder}/x-")


def test_cut_lineage_reads_files(spark):
    out = store.cut_lineage(spark.range(5).withColumn("y", F.lit(1)), "t")
    assert out.count() == 5 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
