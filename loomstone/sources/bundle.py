"""Markdown bundles: scan, parse frontmatter, render, index titles, ingest raw sources, export."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

META = "type string, title string, description string, resource string, tags array<string>, timestamp string, valid_at string, invalid_at string, superseded_by string, sensitive_data boolean, entities array<string>"
KNOWN = [c.split()[0] for c in META.split(", ")]
LISTS = ("tags", "entities")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of every page, path order aside: no index.md, log.md or reviews/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^.*?" + root.rstrip("/").split("://")[-1].replace(".", "\\.") + "/", "")
    return files.select(base.alias("path"), F.decode("content", "UTF-8").alias("raw")).filter(~F.col("path").rlike("(^|/)(index|log)\\.md$") & ~F.col("path").startswith("reviews/"))


def parse_frontmatter(block: str) -> dict:
    """The subset of YAML that frontmatter uses: scalars, quoted strings, inline and dashed lists."""

    def scalar(s: str):
        s = s.strip()
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), s)

    out, key = {}, None
    for line in block.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), scalar(line.lstrip()[2:])]
            continue
        key, sep, value = line.partition(":")
        if not sep:
            raise ValueError(f"no key: {line!r}")
        key, value = key.strip(), value.strip()
        out[key] = [scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else scalar(value)
    return out


def parse_page(raw: str | None) -> tuple[dict | None, str | None, str | None, str | None]:
    """(meta, extra JSON, body, error)."""
    text = (raw or "").removeprefix("﻿").replace("\r\n", "\n")
    if not text.startswith("---\n") or "\n---" not in text[3:]:
        return None, None, None, "no frontmatter"
    head, _, body = text[4:].partition("\n---")
    try:
        fields = parse_frontmatter(head)
    except ValueError as error:
        return None, None, None, str(error)
    if not fields.get("type"):
        return None, None, None, "no type"
    meta = {k: (fields.get(k) if k in LISTS or k == "sensitive_data" else None if fields.get(k) is None else str(fields[k])) for k in KNOWN}
    extra = {k: v for k, v in fields.items() if k not in KNOWN}
    return meta, json.dumps(extra, sort_keys=True), body.lstrip("-").removeprefix("\n"), None


def parse(pages: DataFrame, strict: bool = False) -> DataFrame:
    """(path, meta, extra, body, error) of (path, raw). Strict fails on the first malformed page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_page(r) for r in batch["raw"]]
            if strict and (bad := next((p for p, r in zip(batch["path"], rows, strict=True) if r[3]), None)):
                raise ValueError(f"malformed page {bad}")
            yield pd.DataFrame({"path": batch["path"], "meta": [r[0] for r in rows], "extra": [r[1] for r in rows], "body": [r[2] for r in rows], "error": [r[3] for r in rows]})

    return pages.select("path", "raw").mapInPandas(run, f"path string, meta struct<{META.replace(' ', ':').replace(',:', ',')}>, extra string, body string, error string")


def concepts(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    return parse(scan(spark, root), strict).filter(F.col("error").isNull())


def render(meta: dict, body: str) -> str:
    """A page's text; parse_page(render(m, b)) gives m and b back."""
    lines = []
    for k, v in meta.items():
        if v is None:
            continue
        quote = lambda x: str(x).lower() if isinstance(x, bool) else f'"{x}"' if str(x) != str(x).strip() or str(x)[:1] in "[{'\"#-" or ":" in str(x) else str(x)
        lines += [f"{k}:", *[f"- {quote(x)}" for x in v]] if isinstance(v, list) else [f"{k}: {quote(v)}"]
    return "---\n" + "\n".join(lines) + "\n---\n" + body


def title_index(pages: DataFrame) -> DataFrame:
    """(key, path): lower-case title or stem; the first page in path order wins."""
    keys = F.array(F.lower("title"), F.lower(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "\\.md$", "")))
    return pages.select("path", F.explode(keys).alias("key")).filter("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.min("path").alias("path"))


ALLOWED = ("md", "txt", "html", "pdf", "epub")


def ingest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, content, error): new raw sources under names of their own; collisions get -2, -3 and so on, never overwriting.

    existing: (name); incoming: (filename, content, base64 boolean).
    """
    parts = F.regexp_extract("filename", "^(.*)\\.([^.]*)$", 1), F.lower(F.regexp_extract("filename", "\\.([^.]*)$", 1))
    base = F.trim(F.regexp_replace(F.lower(parts[0]), "[^a-z0-9]+", "-"))
    base = F.regexp_replace(base, "^-+|-+$", "")
    rows = incoming.withColumn("stem", F.when(base == "", "note").otherwise(base)).withColumn("suffix", parts[1])
    taken = existing.select(F.regexp_extract("name", "^(.*?)(-\\d+)?\\.[^.]*$", 1).alias("stem"), F.regexp_extract("name", "\\.([^.]*)$", 1).alias("suffix")).groupBy("stem", "suffix").agg(F.count(F.lit(1)).alias("used"))
    w = Window.partitionBy("stem", "suffix").orderBy("filename", "content")
    n = F.row_number().over(w) + F.coalesce("used", F.lit(0))
    rows = rows.join(taken, ["stem", "suffix"], "left").withColumn("n", n)
    name = F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit("."), "suffix")
    body = F.when(F.col("base64"), F.decode(F.unbase64("content"), "UTF-8")).otherwise(F.col("content"))
    return rows.select(name.alias("name"), body.alias("content"), F.when(~F.col("suffix").isin(*ALLOWED), F.lit("unsupported suffix")).alias("error"))


def strip_html(html):
    """Text of an HTML column: scripts and tags out, common references decoded, white space collapsed."""
    x = F.regexp_replace(html, "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def export(pages: DataFrame, types: list[str] | None = None, tag: str | None = None, include_local: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pages to export, and one manifest row (pages, excluded_private). pages: (path, type, tags, privacy, body)."""
    wanted = pages
    if types:
        wanted = wanted.filter(F.col("type").isin(*types))
    if tag:
        wanted = wanted.filter(F.array_contains("tags", tag))
    private = F.col("privacy") == "local_only"
    manifest = wanted.agg(F.count_if(~F.coalesce(private, F.lit(False)) | F.lit(include_local)).alias("pages"), F.count_if(F.coalesce(private, F.lit(False)) & ~F.lit(include_local)).alias("excluded_private"))
    return (wanted if include_local else wanted.filter(~F.coalesce(private, F.lit(False)))), manifest


@F.pandas_udf(StringType())
def rendered(path: pd.Series, kind: pd.Series, title: pd.Series, tags: pd.Series, body: pd.Series) -> pd.Series:
    """Pages as text, from their commonest fields; parse gives the fields back."""
    return pd.Series([render({"type": k, "title": t, "tags": None if g is None else list(g)}, b) for k, t, g, b in zip(kind, title, tags, body, strict=True)])
