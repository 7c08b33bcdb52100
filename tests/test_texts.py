"""Text functions on cases that the tables don't hold."""

from pyspark.sql import functions as F

from sheafmill.functions import texts as fn

AN, KO, KHO = "ັ", "ກ", "່"


def of(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_defects(spark):
    bad = f"​{KO}{AN}{AN} {AN}x‍"
    found = of(spark, bad, fn.defect_counts)
    assert (found.zero_width, found.doubled_marks, found.blank_before_mark, found.total) == (2, 1, 1, 4)
    once = of(spark, f"{KO}{AN} {AN}", fn.defects_fixed)
    assert once == f"{KO}{AN}{AN}"  # a pass can make a new doubled mark
    assert of(spark, f"{KO}{AN} {AN}", lambda t: fn.defects_fixed(t, 2)) == f"{KO}{AN}"
    assert of(spark, f"{KO} າ", fn.defects_fixed) == f"{KO} າ"  # a blank before a spacing vowel stays
    assert len(of(spark, f"{KO}{AN}{AN} y " * 5 + f"z {KHO}", fn.defect_samples)) == 3


def test_normalised(spark):
    assert of(spark, "  é⁠  ﻿x \n", fn.normalised) == "é x"
    assert of(spark, "", fn.normalised) == ""


def test_language(spark):
    cases = {"": "en", "123": "en", KO * 3: "lo", KO * 9 + "a": "lo", KO + "a" * 9: "en", KO + "a": "mixed"}
    assert {t: of(spark, t, fn.language) for t in cases} == cases


def test_amounts(spark):
    assert of(spark, "1,000 LAK and ₭ 500, 1.000.000 then 1,000 LAK; 3 columns ໑໐໐ ກີບ", fn.amounts) == ["1,000 LAK", "₭ 500", "1.000.000", "໑໐໐ ກີບ"]


def test_accounts(spark):
    assert of(spark, " ໔11", fn.account_attributes).asDict() == {"account_class": "revenue", "normal_balance": "credit", "statement": "PL"}
    assert of(spark, "x", fn.account_attributes).account_class == "asset"
    assert of(spark, "pay 4331 and 411 or 701234 and 4331, 55555", fn.account_codes_in) == ["4331", "701234", "55555"]


def test_sentences(spark):
    assert of(spark, "One. Two!\n\n three ", fn.sentences) == ["One.", "Two!", "three"]


def test_tables(spark):
    assert of(spark, r"| a \| b | c |", fn.pipe_row) == ["a | b", "c"]
    made = spark.range(1).select(fn.table_markdown(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("d")))).alias("x")).first().x
    assert made == "| a | b\\|c |\n|---|---|\n| d |  |"
    assert of(spark, " a | |b ", fn.list_cell) == ["a", "b"]


def test_pages(spark):
    html = "<html><SCRIPT>x<y</script><nav>n</nav><p>a &amp;lt; b&#39;&quot;</p><footer>f</footer></html>"
    assert of(spark, html, fn.page_text) == 'a < b "'
    assert of(spark, "x" * 9000, lambda t: F.length(fn.page_text(t))) == 4000


def test_titles(spark):
    assert of(spark, " \n", fn.title_of) == "New conversation"
    assert of(spark, "a" * 60 + "\nrest", fn.title_of) == "a" * 48 + "…"
    assert of(spark, "ບໍລິສັດ ABC ຈຳກັດ", fn.core_name) == "ABC"


def test_small_helpers(spark):
    from sheafmill.operators import filters, model
    from sheafmill.sources import files, tables

    one = lambda c, **cols: spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(c.alias("x")).first().x
    assert [one(files.source_kind(F.col("p")), p=p) for p in ("a.MD", "b.markdown", "c.docx", "d.txt")] == ["markdown", "markdown", "docx", "other"]
    assert [one(model.path_escapes(F.col("p")), p=p) for p in ("/a", "a/../b", "a..b/c", "a/b")] == [True, True, False, False]
    assert one(filters.with_default_first(F.array(F.lit("a")), "a")) == ["a"] and one(filters.with_default_first(F.array(F.lit("a")), "b")) == ["b", "a"]
    names = spark.createDataFrame([("qwen",), ("",), (None,), ("nomic-embed",), ("llama",)], "name string")
    assert [r.name for r in tables.models(names).collect()] == ["llama", "qwen"]
    lines = spark.createDataFrame([('{"response":"a","done":false}',), ("",), ("bad",), ('{"done":true}',)], "value string")
    assert [tuple(r) for r in files.token_lines(lines).collect()] == [("a", False), ("", True)]
    accounts = spark.createDataFrame([("4", None), ("41", "4"), ("411", "41")], "code string, parent_code string")
    assert {r.code: r.ancestors for r in model.ancestors(accounts).collect()} == {"4": [], "41": ["4"], "411": ["41", "4"]}
    assert model.split_fields("a array<struct<b: int, c: int>>, d decimal(5,4)") == ["a array<struct<b: int, c: int>>", "d decimal(5,4)"]
    made = model.conformed(spark.createDataFrame([("x", "y", "7")], "id string, conversation_id string, role string"), "message")
    assert (made.columns[:3], made.first().role, made.first().text) == (["id", "conversation_id", "role"], "7", None)
    threads = spark.sql("SELECT 'a' AS id, TIMESTAMP '2024-01-01' AS updated_at UNION ALL SELECT 'b', TIMESTAMP '2024-01-02'")
    said = spark.sql("SELECT 'a' AS conversation_id, TIMESTAMP '2024-01-03' AS created_at")
    assert [r.id for r in model.with_recency(threads, said).collect()] == ["a", "b"]


def test_text_files(spark, tmp_path):
    from sheafmill.sources import files, tables

    (tmp_path / "a.txt").write_bytes("ກ".encode("utf-16"))
    (tmp_path / "b.txt").write_bytes(b"plain")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.text_files(spark, str(tmp_path)).collect()} == {"a.txt": "ກ", "b.txt": "plain"}
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.scan(spark, str(tmp_path), "t").count() == 3


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from sheafmill.sources import shared

    on_cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(on_cluster)
    path = shared.written(spark.range(2), "test").inputFiles()[0]
    assert path.startswith("file:")


def test_upper_by_character(spark):
    """As the SQL's engine has it, for each character whose upper case is longer than itself; null and empty texts stay."""
    import duckdb

    rows = [("stra\u00dfe \u00e9",), ("",), (None,), *((f"a{c}b{c}{c}",) for c in fn.GROWING)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(fn.upper_by_character(F.col("t"))).collect()]
    con = duckdb.connect()
    assert len(fn.GROWING) == 102 and got == [con.execute("SELECT upper(?::VARCHAR)", [t]).fetchall()[0][0] for (t,) in rows]
