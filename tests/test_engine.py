"""Sources, ingest, streaming, SQL names, relational operators and the query catalogue."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from jisfold import functions as J
from jisfold.functions import machine
from jisfold.functions.candidates import mj_shrink_candidates
from jisfold.operators import relational
from jisfold.plans import catalog, corpus
from jisfold.refdata import ingest
from jisfold.refdata.tables import parse_men_ku_ten
from jisfold.sources import xlsx

SF = "/root/testdata/sf0.001"


def test_scalar_functions(spark):
    df = spark.createDataFrame([("1-25-66", "U+9AD8", "U+304B u+309a", "8FBA_E0100", "MJ028902"), ("3-1-1", "9AD8", "", "1", "x"), ("1-95-1", "U+110000", None, None, None)], "m string, u string, q string, h string, j string")
    rows = df.select(J.parse_men_ku_ten("m").alias("m"), J.parse_code_point("u").alias("u"), J.parse_code_points("q").alias("q"), J.parse_hex_list("h").alias("h"), J.parse_mj("j").alias("j")).collect()
    assert tuple(rows[0]) == (2321, 0x9AD8, [0x304B, 0x309A], [0x8FBA, 0xE0100], 28902)
    assert [(r.m, r.u) for r in rows[1:]] == [(None, None), (None, None)]
    with pytest.raises(ValueError):
        parse_men_ku_ten("0-1-1")
    taken = spark.createDataFrame([(["a", "b", "", "c"],), (["a"],), ([],), ([None],)], "a array<string>").select(J.take_until_empty("a").alias("t")).collect()
    assert [r.t for r in taken] == [["a", "b"], ["a"], [], []]


def test_cell_references():
    assert xlsx.cell_reference("B3") == (2, 3)
    assert xlsx.cell_range("A1:AC9") == ((1, 1), (29, 9))
    assert xlsx.row_span("1:17") == (1, 17)
    with pytest.raises(ValueError):
        xlsx.cell_reference("3B")


def test_xlsx_kinds_of_cells(tmp_path, spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>plain</t><rPh><t>no</t></rPh></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><dimension ref="A1:E2"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2" spans="1:5"><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="D2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    rows = ingest.sheet(spark, f"file://{tmp_path}").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["plain", None, "rich", None, None], [None, "in", None, "2", None]]


def test_ingest_builds_all_tables(tmp_path, spark):
    head = catalog.jis_book([])

    def row(**cells):
        return [cells.get(f"c{i}") for i in range(17)]

    jis = [
        row(c0="1-4-84", c1="U+3094", c3="追加非漢字", c4="1-5-84", c5="U+30F4"),
        row(c0="1-8-33", c1="U+3251", c3="追加非漢字", c7="1-3-18", c8="1-3-17", c11="U+FF12", c12="U+FF11", c16="類似字形U+2460は本文字に変換する。"),
        row(c0="1-4-87", c1="U+304B U+309A", c3="追加非漢字"),
        row(c0="1-5-84", c1="U+30F4", c3="非漢字"),
        row(c0="1-3-17", c1="U+FF11", c3="非漢字"),
        row(c0="1-3-18", c1="U+FF12", c3="非漢字"),
        row(),
        row(c0="1-3-19", c1="U+FF13", c3="非漢字"),
    ]
    mj = [list(ingest.MJ_HEAD), [None, None, "MJ000002", "U+9089", "U+9089", "9089_E010F", ""], [None, None, "MJ000001", "U+908A", None, "908A_E0108;908A_E0109", "908A_FE00"], [None, None, None, "U+1"]]
    (tmp_path / "j.xlsx").write_bytes(catalog.workbook(head + jis))
    (tmp_path / "m.xlsx").write_bytes(catalog.workbook(mj))
    content = [{ingest.MJ_NAME: "MJ000002", ingest.SCHEME_LABELS[3]: [{"UCS": "U+8FBA"}, {"UCS": "U+908A"}]}]
    (tmp_path / "s.json").write_text(json.dumps({"content": content}, ensure_ascii=False))
    from jisfold.refdata.__main__ import main

    main([*(f"file://{tmp_path / n}" for n in ("j.xlsx", "m.xlsx", "s.json")), f"file://{tmp_path}/out"])
    table, mjs = ingest.load(spark, f"file://{tmp_path}/out")
    assert len(table.rows) == 6
    assert machine.encode("jis", "ゔ㉑", 3, table).hex() == "257423322331"
    assert machine.encode("jis", "か゚", 1, table).hex() == "2477"
    assert spark.read.parquet(f"file://{tmp_path}/out/pair_to_jis").count() == 1
    assert mjs.variants[1] == [(0x908A, None), (0x908A, 0), (0x908A, 24), (0x908A, 25)]
    got = spark.createDataFrame([("邉",)], "s string").select(J.mj_shrink_candidates("s", 8, table=mjs)).first()[0]
    assert got == ["辺", "邊", "邉"]


def test_a_build_takes_the_place_of_the_one_before(tmp_path, spark):
    for name in ("a", "b"):
        spark.range(1).write.parquet(f"file://{tmp_path}/{name}/{name}")
    ingest._replace(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/dest")
    ingest._replace(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/dest")
    assert [p.name for p in tmp_path.iterdir()] == ["dest"] and [p.name for p in (tmp_path / "dest").iterdir()] == ["b"]
    with pytest.raises(OSError, match="could not be renamed"):
        ingest._replace(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/dest")
    assert [p.name for p in (tmp_path / "dest").iterdir()] == ["b"]


def test_ingest_refuses_bad_hexadecimal(tmp_path, spark):
    for bad in ("XYZ_E0101", "8FBAQQ_E0101", "FFFFFFFFF_E0101"):
        rows = [list(ingest.MJ_HEAD), [None, None, "MJ000001", "U+9089", None, f"9089_E010F;{bad}", ""]]
        (tmp_path / "mj.xlsx").write_bytes(catalog.workbook(rows))
        found = ingest.mj_problems(ingest.sheet(spark, f"file://{tmp_path}/mj.xlsx")).collect()
        assert [tuple(r) for r in found] == [(2, "an ideographic variation sequence cannot be read")]


def test_ingest_refuses_other_layouts(tmp_path, spark):
    def refused(name, rows, problems):
        (tmp_path / name).write_bytes(catalog.workbook(rows))
        with pytest.raises(ingest.InvalidFormatError) as e:
            ingest.refuse(problems(ingest.sheet(spark, f"file://{tmp_path / name}")), name)
        return str(e.value)

    assert "row 2: the row is missing" in refused("short.xlsx", catalog.jis_book([])[:1], ingest.jis_problems)
    assert refused("bad.xlsx", catalog.jis_book([r for r, _ in catalog.BAD_JIS_ROWS]), ingest.jis_problems).count("row ") == 10
    found = refused("mj.xlsx", [["h"] * 7, [None, None, "M1", "U+1"], [None, None, "MJ000001", "1"], [None, None, "MJ000001", "U+1", None, "1_1"], [None, None, "MJ000001", "U+1", None, "", "1"]], ingest.mj_problems)
    assert [found.count(f"row {n}:") for n in range(1, 6)] == [1] * 5
    with pytest.raises(ingest.InvalidFormatError):
        ingest.build(spark, f"file://{tmp_path}/bad.xlsx", f"file://{tmp_path}/mj.xlsx", "none.json", f"file://{tmp_path}/out")


def test_duplicate_code_points_are_an_error():
    from jisfold.refdata.tables import JisRow, JisTable

    with pytest.raises(ValueError):
        JisTable({1: JisRow(1, "a", 1), 2: JisRow(2, "a", 1)})
    second = JisTable({1: JisRow(1, "a", 1, sus="b")}, use_secondary=True)
    assert set(second.by_text) == {"a", "b"}


def test_relational(spark):
    t1 = catalog.jis_map(spark)
    assert relational.densify(t1.select("jis", "class"), "jis", {"class": 0}).where("class = 0").count() == 17672 - 11233
    df = spark.createDataFrame([(x,) for x in (1, 2, 5, 9, 200000, 200003)], "u int")
    assert sorted(map(tuple, relational.islands(df, "u", 4, block=4).collect())) == [(1, 5, 3), (9, 9, 1), (200000, 200003, 2)]
    assert relational.longest(t1, "us").first()[0] == 2
    doubled = t1.limit(3).withColumn("sus", F.array(F.lit(1)))
    assert relational.with_secondary(doubled).count() == 6
    assert spark.range(1).select(F.array(F.lit(1)).alias("a")).select(relational.padded("a", 3, 0)).first()[0] == [1, 0, 0]


def test_sql_names(spark):
    from jisfold import sql

    sql.register(spark)
    row = spark.sql("SELECT hex(jnta_encode('か゚', 1)) a, jnta_decode(x'2477') b, jnta_shrink_translit('麴町', '?', false) c, mj_shrink_candidates('髙', 1, 100) d").first()
    assert tuple(row) == ("2477", "か゚", "麹町", ["高", "髙"])
    row = spark.sql("SELECT hex(jnta_encode('か゚')) a, try_jnta_encode('✋', 1) b, jnta_encode_with_error('か✋', 1) c, try_jnta_decode(x'21') d, jnta_decode_with_error(x'2124247C') e, jnta_shrink_translit('✋') f, try_jnta_shrink_translit('✋') g, mj_shrink_candidates('髙', 1) h, try_jnta_encode(NULL, 1) i").first()
    assert row.a == "2477" and row.b is None and tuple(row.c)[1:] == ("not convertible to JISX0208", 1, 2) and row.d is None
    assert tuple(row.e) == (None, "JIS character 1-37-125 does not have a corresponding unicode codepoint", 2, 4)
    assert (row.f, row.g, row.h, row.i) == ("\ufffd", None, ["高", "髙"], None)


def test_sql_names_stay_in_the_jvm(spark):
    from jisfold import sql

    sql.register(spark)
    spark.createDataFrame([(i, t, i % 4) for i, t in enumerate([*corpus.TEXTS, None])], "i int, s string, m int").createOrReplaceTempView("sql_texts")
    for mode in range(4):
        df = spark.sql(f"SELECT i, s, hex(try_jnta_encode(s, {mode})) AS h, jnta_encode_with_error(s, {mode}).start AS e FROM sql_texts")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        own = spark.table("sql_texts").select("i", "s", F.hex(J.try_jnta_encode("s", mode)).alias("h"), J.jnta_encode_with_error("s", mode)["start"].alias("e"))
        assert sorted(map(repr, df.collect())) == sorted(map(repr, own.collect()))
    by_row = spark.sql("SELECT i, hex(try_jnta_encode(s, m)) AS h, try_jnta_decode(try_jnta_encode(s, 1)) AS d, mj_shrink_candidates(s, m * 5, 7) AS c, mj_shrink_candidates(s, 15, -1) AS a, mj_shrink_candidates(s, 15, 0) AS z, mj_candidate_count(s, m) AS n, mj_candidate_at(s, 15, m) AS k FROM sql_texts").collect()
    texts = [*corpus.TEXTS, None]
    for r in by_row:
        t, m = texts[r.i], r.i % 4
        if t is None:
            assert tuple(r)[1:] == (None,) * 7
            continue
        every = mj_shrink_candidates(t, 15, -1)
        assert (r.c, r.a, r.z, r.n) == (mj_shrink_candidates(t, m * 5, 7), every, [], len(mj_shrink_candidates(t, m, -1)))
        assert r.k == (every[m] if m < len(every) else None)
        try:
            assert r.h == machine.encode("jis", t, m).hex().upper()
        except UnicodeEncodeError:
            assert r.h is None
    shrunk = spark.sql("SELECT s, jnta_shrink_translit(s, '[?]') AS a, jnta_shrink_translit(s, '', true) AS b, try_jnta_shrink_translit(s) AS c FROM sql_texts WHERE s IS NOT NULL").collect()
    for r in shrunk:
        assert (r.a, r.b) == (machine.shrink_translit(r.s, "[?]"), machine.shrink_translit(r.s, "", True))
        assert r.c == (None if "\x00" in machine.shrink_translit(r.s, "\x00") else machine.shrink_translit(r.s, "?"))
    for bad in ("jnta_encode('✋', 1)", "jnta_decode(x'21')", "jnta_shrink_translit('✋', '')"):
        with pytest.raises((UnicodeError, J.TransliterationError)), J.typed_errors():
            spark.sql(f"SELECT {bad}").collect()
    with pytest.raises(Exception, match="there is no mode 9"):
        spark.sql("SELECT jnta_encode('a', 9)").collect()


def test_stream_forgets_a_text_at_its_end(spark, tmp_path):
    from jisfold.streaming.encoder import OUT_OF_ORDER, encode_stream

    batches = [[("a", 0, "か", False), ("b", 5, "山", True)], [("a", 1, "゚", True), ("a", 0, "山", False), ("b", 0, "か", False)], [("a", 0, "か", False), ("a", 1, "か", True)]]
    (tmp_path / "in").mkdir()
    parts = spark.readStream.schema("stream_id string, seq long, text string, final boolean").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    run = encode_stream(parts, 1).writeStream.outputMode("append").format("memory").queryName("forgetful").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for i, rows in enumerate(batches):
            (tmp_path / "new").write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "text", "final"), r, strict=True))) for r in rows))
            (tmp_path / "new").rename(tmp_path / "in" / f"{i}.json")
            run.processAllAvailable()
    finally:
        run.stop()
    found = [(r.stream_id, r.seq, None if r.bytes is None else r.bytes.hex(), r.reason) for r in spark.table("forgetful").collect()]
    # parts of a micro-batch go by number: a's 0 comes before its last part, and is late
    assert sorted(found, key=repr) == sorted([("a", 0, "", None), ("b", 5, "3b33", None), ("a", 0, None, OUT_OF_ORDER), ("a", 1, "2477", None), ("b", 0, "", None), ("a", 0, "", None), ("a", 1, "242b242b", None)], key=repr)


def test_stream_equals_the_whole(spark):
    rows = catalog.stream_encode(spark, SF).collect()
    streamed = {k: corpus.TEXTS[k % len(corpus.TEXTS)] for k in (r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()) if k % len(corpus.TEXTS) in catalog._STREAMED_PLACES}
    assert len(streamed) > 100 and len(rows) == len(streamed)
    for r in rows:
        t = streamed[r.stream_id]
        try:
            assert (r.jis_hex, r.errors) == (machine.encode("jis", t, 0).hex().upper(), 0), t
        except UnicodeEncodeError:
            assert r.errors > 0, t


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "nation", "part", "orders", "supplier", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, sql))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
