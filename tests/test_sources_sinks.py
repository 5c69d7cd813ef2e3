"""Readers, parsers, writers and streams."""

import json

from pyspark.sql import functions as F

from athenor.sinks import exports
from athenor.sources import api, text_files
from athenor.streaming import garden


def test_json_collection(spark, tmp_path):
    data = {"papers": [{"Title": "A", "DOI": "https://doi.org/10.1/X", "publication_year": "2001", "authors": ["a", "b", "c", "d", "e", "f"], "category": "k", "citations": 3}, {"abstract": "no title"}]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    r = text_files.read_collection(spark, str(tmp_path / "c.json")).collect()
    assert len(r) == 1 and (r[0].doi, r[0].year, len(r[0].authors), r[0].concepts[0].name, r[0].citation_count) == ("10.1/x", 2001, 5, "k", 3)


def test_csv_collection(spark, tmp_path):
    (tmp_path / "c.csv").write_text('TITLE,Year,Authors\n"One, two",x,"A B, C D"\n,1999,\n')
    r = text_files.read_collection(spark, str(tmp_path / "c.csv")).collect()
    assert len(r) == 1 and (r[0].title, r[0].year, r[0].authors) == ("One, two", None, ["A B", "C D"])


def test_markdown_and_pmids(spark, tmp_path):
    (tmp_path / "c.md").write_text("see [x](https://doi.org/10.1000/ABC) and 10.1000/abc, also doi:10.2000/z.")
    (tmp_path / "c.txt").write_text("123\nabc\n 456 \n")
    assert sorted(r.doi for r in text_files.read_collection(spark, str(tmp_path / "c.md")).collect()) == ["10.1000/abc", "10.2000/z"]
    assert sorted(r.pmid for r in text_files.read_collection(spark, str(tmp_path / "c.txt")).collect()) == ["123", "456"]


def test_bibtex_and_ris(spark, tmp_path):
    (tmp_path / "c.bib").write_text('@comment{x}\n@article{k1, title = {A {Nested} Review}, author = "A One and B Two", year = 2003, journal = {J}, doi={10.1/q}}')
    (tmp_path / "c.ris").write_text("TY  - JOUR\nTI  - Plain\nAU  - One, A\nAU  - Two, B\nPY  - 1999/01\nDO  - 10.5/R\nER  -\n")
    b = text_files.read_collection(spark, str(tmp_path / "c.bib")).first()
    assert (b.title, b.authors, b.year, b.venue, b.doi, b.is_review) == ("A Nested Review", ["A One", "B Two"], 2003, "J", "10.1/q", True)
    r = text_files.read_collection(spark, str(tmp_path / "c.ris")).first()
    assert (r.title, r.authors, r.year, r.doi, r.is_review) == ("Plain", ["One, A", "Two, B"], 1999, "10.5/r", False)


def test_reference_parsing(spark):
    text = 'Body\nReferences\n[1] A. One (2001). "A quoted title here". doi:10.1234/ab. [2] B. Two 1999. Another title of note. J. [3] C\nAppendix\nx'
    df = spark.createDataFrame([(text,)], "t string").select(text_files.references_section(F.col("t")).alias("s"))
    parts = df.select(F.explode(text_files.reference_entries(F.col("s"))).alias("e")).select(text_files.parse_reference(F.col("e")).alias("p"), "e").select("p.*").collect()
    assert (parts[0].year, parts[0].doi, parts[0].title) == (2001, "10.1234/ab", "A quoted title here")
    assert (parts[1].year, parts[1].title) == (1999, "Another title of note")


def pages(number, size, pushed):
    rows = [(f"W{number * size + i}", f"t{i}", 2000 + i, i, "{}") for i in range(size)]
    return [r for r in rows if r[2] >= pushed.get("year_min", 0)]


def test_service_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(api.WorksSource)
    df = spark.read.format("works").option("client", "tests.test_sources_sinks:pages").option("pages", 2).option("page_size", 5).load()
    assert df.where("year >= 2003").count() == 4


def test_parse_works(spark):
    raw = json.dumps({"id": "W1", "doi": "https://doi.org/10.1/A", "title": "A review of x", "publication_year": 2000, "type": "article", "referenced_works": ["a", "b"], "authorships": [{"author": {"id": "A1", "display_name": "N"}}], "concepts": [{"display_name": "c", "score": 0.5}]})
    r = api.parse_works(spark.createDataFrame([(raw,), ("broken",)], "raw string"), "raw").collect()
    assert len(r) == 1 and (r[0].doi, r[0].reference_count, r[0].authors, r[0].is_review, r[0].citation_count) == ("10.1/a", 2, ["N"], True, 0)


def test_exports(spark):
    nodes = spark.createDataFrame([(1, 'a<"b">', 4), (2, "c", 9)], "node int, label string, citation_count int")
    edges = spark.createDataFrame([(1, 2, 1.5)], "src int, dst int, weight double")
    text = "".join(r.value for r in exports.graphml_rows(nodes, edges).orderBy("part", "value").collect())
    import xml.etree.ElementTree as tree

    assert len(list(tree.fromstring(text).iter())) == 10
    tree.fromstring("".join(r.value for r in exports.gexf_rows(nodes, edges).orderBy("part").collect()))
    points, links = exports.flourish(nodes, edges)
    assert {r["size"] for r in points.collect()} == {2.0, 3.0} and links.first().target_label == "c"
    assert [json.loads(r.value)["kind"] for r in exports.json_rows(nodes, edges).collect()] == ["node", "node", "edge"]
    assert exports.dot_rows(edges).first().value == '"1" -> "2";'
    papers = spark.createDataFrame([("T", ["Ann Lee"], 2001, "J", None)], "title string, authors array<string>, year int, venue string, doi string")
    assert exports.bibtex_rows(papers).first().value.startswith("@article{lee2001,\n  title = {T}")


def test_store_grows_batch_by_batch(spark, tmp_path):
    schema = "id string, title string, citation_count long"
    source = tmp_path / "in"
    for rows in ([("a", "t", 1), ("b", None, 2)], [("b", "new", 1), ("c", "x", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        garden.grow(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/generation=1")).collect()))
    assert got == [("a", "t", 1), ("b", "new", 2), ("c", "x", 5)]


def test_drift_monitor(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("q", i, 0.0) for i in range(30)], "k string, i int, r double").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("k string, i int, r double").parquet(str(source))
    q = garden.drift_monitor(stream, "k", "i", "r").writeStream.outputMode("update").format("memory").queryName("drifted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select k, seen, share, stop from drifted").collect()] == [("q", 30, 0.0, True)]
