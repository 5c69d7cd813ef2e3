"""Collections in text formats as DataFrames of paper records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from athenor.functions.exprs import normalize_doi

#: Spellings of a field in collection files, best first.
ALIASES = {
    "doi": ("doi", "DOI", "Doi"),
    "title": ("title", "Title", "paper_title", "name"),
    "year": ("year", "Year", "publication_year", "pub_year"),
    "venue": ("venue", "journal", "Journal", "source"),
    "authors": ("authors", "Authors", "author"),
    "abstract": ("abstract", "Abstract", "summary"),
    "citation_count": ("citation_count", "citations", "cited_by_count"),
    "category": ("category", "topic", "field"),
}
RECORD = "doi string, title string, year int, venue string, authors array<string>, abstract string, citation_count bigint, concepts array<struct<name:string,score:double>>"

DOI = r"(10\.\d{4,9}/[^\s\"<>\]\)]+)"


def _pick(df: DataFrame, field: str, kind: str = "string") -> Column:
    """First non-empty column among a field's spellings."""
    lower = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{lower[a.lower()]}`") for a in ALIASES[field] if a.lower() in lower]
    found = [F.nullif(F.trim(c.cast("string")), F.lit("")) if kind == "string" else c for c in found]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def _records(df: DataFrame, authors: Column) -> DataFrame:
    category = _pick(df, "category")
    concept = F.array(F.struct(category.alias("name"), F.lit(1.0).alias("score")))
    out = df.select(
        normalize_doi(_pick(df, "doi")).alias("doi"),
        _pick(df, "title").alias("title"),
        _pick(df, "year").try_cast("int").alias("year"),
        _pick(df, "venue").alias("venue"),
        F.slice(authors, 1, 5).alias("authors"),
        _pick(df, "abstract").alias("abstract"),
        _pick(df, "citation_count").try_cast("bigint").alias("citation_count"),
        F.when(category.isNotNull(), concept).otherwise(F.array().cast("array<struct<name:string,score:double>>")).alias("concepts"),
    )
    return out.where(F.col("title").isNotNull() | F.col("doi").isNotNull())


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or an object with one under papers, results, data or items; rows without title and DOI go."""
    df = spark.read.json(path, multiLine=True)
    for name in ("papers", "results", "data", "items"):
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            df = df.select(F.explode(name).alias("r")).select("r.*")
            break
    kind = next((df.schema[c].dataType for c in df.columns if c.lower() in ("authors", "author")), None)
    if isinstance(kind, T.ArrayType):
        authors = F.coalesce(*(F.col(c) for c in df.columns if c.lower() in ("authors", "author")))
        if isinstance(kind.elementType, T.StructType):
            authors = F.transform(authors, lambda a: a["name"])
    else:
        authors = F.transform(F.split(_pick(df, "authors"), ","), F.trim)
    return _records(df, authors)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by name in any case; authors separated by commas; a year that is no number is null."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return _records(df, F.transform(F.split(_pick(df, "authors"), r"\s*,\s*"), F.trim))


def read_pmids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("pmid")).where(F.col("pmid").rlike(r"^\d+$")).distinct()


def dois_in(text: Column) -> Column:
    """Distinct normalised DOIs in their order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOI), F.lit(1))
    return F.array_distinct(F.transform(found, normalize_doi))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(dois_in(F.col("value"))).alias("doi")).distinct()


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .json, .csv, .md, .txt (PMIDs), .bib, .ris."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"json": read_json, "csv": read_csv, "md": read_markdown, "txt": read_pmids, "bib": read_bibtex, "ris": read_ris}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind} files")
    return readers[kind](spark, path)


def first_per_doi(records: DataFrame, order: str) -> DataFrame:
    """One record for each DOI, the first by ``order``; records without a DOI all stay."""
    rank = Window.partitionBy("doi").orderBy(order)
    return records.withColumn("_r", F.when(F.col("doi").isNull(), 1).otherwise(F.row_number().over(rank))).where("_r = 1").drop("_r")


def split_bibtex(text: str) -> Iterator[dict]:
    """Entries of a BibTeX file; braces may nest, values may be quoted."""
    at = 0
    while (at := text.find("@", at)) >= 0:
        start = text.find("{", at)
        if start < 0:
            return
        kind, depth, end = text[at + 1 : start].strip().lower(), 1, start + 1
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        body, at = text[start + 1 : end - 1], end
        if kind in ("comment", "preamble", "string") or "," not in body:
            continue
        fields: dict = {"kind": kind, "key": body.split(",", 1)[0].strip()}
        i = body.index(",") + 1
        while (eq := body.find("=", i)) >= 0:
            name, j = body[i:eq].strip(" ,\n\t\r").lower(), eq + 1
            while j < len(body) and body[j].isspace():
                j += 1
            depth, quoted, k = 0, False, j
            while k < len(body) and not (body[k] == "," and depth == 0 and not quoted):
                depth += {"{": 1, "}": -1}.get(body[k], 0)
                quoted ^= body[k] == '"' and depth == 0
                k += 1
            fields[name] = " ".join(body[j:k].strip().strip('"').replace("{", "").replace("}", "").split())
            i = k + 1
        yield fields


def split_ris(text: str) -> Iterator[dict]:
    """Entries of a RIS file; repeated tags gather."""
    entry: dict = {}
    for line in text.splitlines():
        if len(line) >= 5 and line[2:5] == "  -":
            tag, value = line[:2], line[6:].strip()
            if tag == "ER":
                if entry:
                    yield entry
                entry = {}
            else:
                entry.setdefault(tag, []).append(value)
    if entry:
        yield entry


def _parsed(df: DataFrame, entries) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for text in batch["value"] for r in entries(text)], columns=["key", "kind", "doi", "title", "year", "venue", "authors", "abstract"])

    raw = df.mapInPandas(run, "key string, kind string, doi string, title string, year string, venue string, authors array<string>, abstract string")
    review = F.lower(F.coalesce("title", F.lit(""))).contains("review") | F.lower(F.coalesce("kind", F.lit(""))).contains("review")
    return raw.withColumns({"doi": normalize_doi("doi"), "year": F.expr("try_cast(substring(year, 1, 4) as int)"), "is_review": review}).where("title is not null or doi is not null")


def _bib_rows(text: str) -> Iterator[tuple]:
    for e in split_bibtex(text):
        authors = [a.strip() for a in e.get("author", "").split(" and ") if a.strip()]
        yield e["key"], e["kind"], e.get("doi"), e.get("title"), e.get("year"), e.get("journal") or e.get("booktitle"), authors, e.get("abstract")


def _ris_rows(text: str) -> Iterator[tuple]:
    for e in split_ris(text):
        one = lambda *tags, e=e: next((e[t][0] for t in tags if e.get(t)), None)
        yield one("ID"), one("TY"), one("DO"), one("TI", "T1"), one("PY", "Y1"), one("JO", "JF", "T2"), e.get("AU") or e.get("A1") or [], one("AB", "N2")


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """One file in one task, files side by side."""
    return _parsed(spark.read.text(path, wholetext=True), _bib_rows)


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark.read.text(path, wholetext=True), _ris_rows)


def references_section(text: Column) -> Column:
    """What stands between a reference heading and the next end heading."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)\n\s*(?:references|bibliography|works cited|literature cited)\s*\n(.*?)(?:\n\s*(?:appendix|acknowledg|supplementary|author contributions)|\z)", 1)


def reference_entries(section: Column) -> Column:
    """Entries of a reference section: by [n], else by n., else by paragraphs of over fifty characters."""
    clean = lambda parts: F.filter(F.transform(parts, F.trim), lambda x: x != "")
    bracket, dotted = clean(F.split(section, r"\[\d+\]")), clean(F.split(section, r"(?:^|\n)\s*\d+\.\s+"))
    paragraphs = F.filter(clean(F.split(section, r"\n\s*\n")), lambda x: F.length(x) > 50)
    return F.when(F.size(bracket) > 2, bracket).when(F.size(dotted) > 2, dotted).otherwise(paragraphs)


def parse_reference(entry: Column) -> Column:
    """year, doi and title of one entry: the quoted title, else what follows the year, else the first hundred characters."""
    year = F.regexp_extract(entry, r"\b((?:19|20)\d{2})\b", 1)
    quoted = F.regexp_extract(entry, "[\"“]([^\"”]{10,})[\"”]", 1)
    after = F.regexp_extract(entry, r"(?:19|20)\d{2}\)?[.,]?\s*([^.]{10,})\.", 1)
    title = F.when(quoted != "", quoted).when(after != "", F.trim(after)).otherwise(F.substring(entry, 1, 100))
    return F.struct(year.try_cast("int").alias("year"), F.get(dois_in(entry), 0).alias("doi"), title.alias("title"))


def read_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("json", "csv", "md", "bib", "ris"), per_file: int | None = None) -> DataFrame:
    """All files of the extensions below ``path`` as (doi, title, year, source), at most ``per_file`` records of each, one for each DOI.

    Of records with one DOI that of the first file by name, then by title, stays; those without a DOI all stay. Only the files' names
    are listed by the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    names = [r.path for r in files.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$")).orderBy("path").collect()]
    found = spark.createDataFrame([], "doi string, title string, year int, source string")
    for name in names:
        records = read_collection(spark, name)
        own = records.select(*(F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in (("doi", "string"), ("title", "string"), ("year", "int"))), F.lit(name).alias("source"))
        found = found.unionByName(own if per_file is None else own.orderBy("doi", "title").limit(per_file))
    return first_per_doi(found.withColumn("_order", F.concat_ws("|", "source", "title")), "_order").drop("_order")


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """A .bib or .ris file by its extension; of any other extension the reading that finds more records."""
    if path.lower().endswith(".bib"):
        return read_bibtex(spark, path)
    if path.lower().endswith(".ris"):
        return read_ris(spark, path)
    bib, ris = read_bibtex(spark, path), read_ris(spark, path)
    return bib if bib.count() >= ris.count() else ris


def references_of(texts: DataFrame, known: DataFrame, most: int = 100) -> DataFrame:
    """(id, own_doi, kind, doi, title, year) of the references in whole texts(id, text).

    The first DOI of a text is its own; the next ``most`` ones are references, completed from known(doi, title, year); then
    come the entries of the reference section whose DOI is none of these, or who have none but a title.
    """
    all_dois = texts.select("id", "text", dois_in(F.col("text")).alias("dois"))
    own = F.get("dois", 0)
    cited = all_dois.select("id", own.alias("own_doi"), F.explode(F.slice("dois", 2, most)).alias("doi"))
    resolved = cited.join(known.select("doi", "title", "year"), "doi", "left").select("id", "own_doi", F.lit("doi").alias("kind"), "doi", "title", "year")
    entries = all_dois.select("id", own.alias("own_doi"), F.explode(reference_entries(references_section(F.col("text")))).alias("entry"))
    parsed = entries.select("id", "own_doi", parse_reference(F.col("entry")).alias("p")).select("id", "own_doi", F.lit("entry").alias("kind"), "p.doi", "p.title", "p.year")
    new = parsed.join(cited.select("id", "doi"), ["id", "doi"], "left_anti").where("doi is null or own_doi is null or doi <> own_doi")
    return resolved.unionByName(new.select(resolved.columns))
