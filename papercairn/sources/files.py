"""Where papers come from: files, ledgers of lines, canonical documents, XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

META = "struct<doi:string,pmid:string,pmcid:string,title:string,authors:array<string>,journal:string,year:int,mesh:array<string>,keywords:array<string>,pub_types:array<string>,rcr:double,citation_count:int,is_open_access:boolean>"
DOCUMENT = (
    f"paper_id string, source string, schema_version string, quality_score double, source_file string, meta {META}, abstract string, abstract_source string, "
    "body_text array<struct<path:array<string>,section_type:string,paragraphs:array<struct<id:string,text:string,cited_refs:array<string>,cited_keys:array<string>,refs_figure:array<string>,refs_table:array<string>>>>>, "
    "figures array<struct<id:string,caption:string,image:string>>, tables array<struct<id:string,caption:string,markdown:string,source:string,graphic:string,footnote:string>>, "
    "references array<struct<key:string,number:int,doi:string,pmid:string,title:string,year:int,journal:string,authors:array<string>,raw:string,source:string>>"
)


def manifest(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(file, filename, sha1, bytes) of every file below a folder. Contents are hashed where they are read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.sha1("content").alias("sha1"), F.col("length").alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; one that can't be read fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): lines of JSON that can be read, and the text of those that can't. Blank lines and byte-order marks don't
    count."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("line")).filter(F.trim("line") != "")
    parsed = lines.select("line", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    wrong = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.filter(~wrong).select("r.*").drop("_corrupt"), parsed.filter(wrong).select("line")


def last_entries(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key of a ledger, by its order."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return ledger.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, without parsing them."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical documents, one JSON object a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)


def relations(docs: DataFrame) -> dict[str, DataFrame]:
    """Canonical documents as relations: papers, paragraphs, figures, tables, references. Sections without paragraphs and
    documents without sections leave no rows in paragraphs; every document stays in papers."""
    s = docs.select("paper_id", F.posexplode("body_text").alias("sec_ord", "s"))
    p = s.select("paper_id", "sec_ord", "s.path", "s.section_type", F.posexplode("s.paragraphs").alias("par_ord", "p")).select("paper_id", "sec_ord", "par_ord", "path", "section_type", "p.*")
    each = lambda c: docs.select("paper_id", F.posexplode(c).alias("ord", "x")).select("paper_id", "ord", "x.*")
    return {"papers": docs.drop("body_text", "figures", "tables", "references"), "paragraphs": p, "figures": each("figures"), "tables": each("tables"), "references": each("references")}


def nested(rel: dict[str, DataFrame]) -> DataFrame:
    """The inverse of relations(), for writing canonical documents: paper by paper, sections and paragraphs in order."""
    fields = lambda df: [c for c in df.columns if c not in ("paper_id", "sec_ord", "par_ord", "path", "section_type", "ord")]
    p = rel["paragraphs"]
    strip = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    s = p.groupBy("paper_id", "sec_ord").agg(F.first("path").alias("path"), F.first("section_type").alias("section_type"), strip(F.struct(F.col("par_ord").alias("o"), F.struct(*fields(p)).alias("v"))).alias("paragraphs"))
    out = rel["papers"].join(s.groupBy("paper_id").agg(strip(F.struct(F.col("sec_ord").alias("o"), F.struct("path", "section_type", "paragraphs").alias("v"))).alias("body_text")), "paper_id", "left")
    for name in ("figures", "tables", "references"):
        df = rel[name]
        out = out.join(df.groupBy("paper_id").agg(strip(F.struct(F.col("ord").alias("o"), F.struct(*fields(df)).alias("v"))).alias(name)), "paper_id", "left")
    return out


# ---- XML -------------------------------------------------------------------------------------------------------------


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if _tag(c) in names]


def _flat(e: ET.Element, numbers: dict[str, str], cited: list, figures: list, tables: list) -> str:
    """Text of a paragraph: references to the literature as [n], those to figures and tables as printed, what floats in it and
    formulas left out."""
    out = [e.text or ""]
    for c in e:
        t = _tag(c)
        kind = c.get("ref-type") or c.get("type") or ""
        target = (c.get("rid") or c.get("target") or "").lstrip("#")
        if t in ("xref", "ref") and kind in ("bibr", "bib"):
            cited.append(target or f"num:{re.sub(r'\\D', '', ''.join(c.itertext()))}")
            n = numbers.get(target) or re.sub(r"[^\d,–-]", "", "".join(c.itertext()))
            out.append(f"[{n}]" if n else "")
        elif t in ("xref", "ref") and kind in ("fig", "figure", "table"):
            (tables if kind == "table" else figures).append(target)
            out.append("".join(c.itertext()))
        elif t not in ("fig", "figure", "table-wrap", "disp-formula", "inline-formula", "formula", "graphic"):
            out.append(_flat(c, numbers, cited, figures, tables))
        out.append(c.tail or "")
    return re.sub(r"\s+", " ", "".join(out))


def _rows(table: ET.Element) -> list[list[str]]:
    """Cells of a table, those that span several places repeated in each."""
    out: list[dict[int, str]] = []
    carried: dict[tuple[int, int], str] = {}
    for r, row in enumerate(x for x in table.iter() if _tag(x) in ("tr", "row")):
        here, col = {}, 0
        for cell in _children(row, "td", "th", "cell"):
            while (r, col) in carried:
                here[col] = carried[r, col]
                col += 1
            text = re.sub(r"\s+", " ", "".join(cell.itertext())).strip().replace("|", "\\|")
            for i in range(int(cell.get("colspan") or cell.get("cols") or 1)):
                for j in range(int(cell.get("rowspan") or cell.get("rows") or 1)):
                    carried[r + j, col + i] = text
                here[col + i] = text
            col += int(cell.get("colspan") or cell.get("cols") or 1)
        while (r, col) in carried:
            here[col] = carried[r, col]
            col += 1
        out.append(here)
    wide = max((max(x, default=-1) + 1 for x in out), default=0)
    return [[x.get(i, "") for i in range(wide)] for x in out]


def _markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * len(rows[0])) + " |", *map(line, rows[1:])])


def parse_xml(paper_id: str, xml: str) -> list[dict]:
    """Rows (kind, sec_ord, par_ord, path, id, text, markdown, cited_keys, refs_figure, refs_table) of a paper in JATS or TEI:
    its abstract, paragraphs in order with the headings above them, tables, figures and references. Articles within the
    article don't count. An XML that can't be read gives one row of kind error."""
    base = {"paper_id": paper_id, "kind": None, "sec_ord": None, "par_ord": None, "path": [], "id": None, "text": None, "markdown": None, "cited_keys": [], "refs_figure": [], "refs_table": []}
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml))
    except ET.ParseError as e:
        return [base | {"kind": "error", "text": str(e)[:200]}]
    for parent in list(root.iter()):
        for c in _children(parent, "sub-article", "response"):
            parent.remove(c)
    out: list[dict] = []
    numbers: dict[str, str] = {}
    for n, ref in enumerate((e for e in root.iter() if _tag(e) == "ref" and e.get("id") or _tag(e) == "biblStruct"), 1):
        key = ref.get("id") or ref.get("{http://www.w3.org/XML/1998/namespace}id") or f"b{n - 1}"
        label = next((re.sub(r"\D", "", "".join(c.itertext())) for c in ref.iter() if _tag(c) == "label"), "")
        numbers[key] = label or str(n)
        out.append(base | {"kind": "reference", "par_ord": n, "id": key, "text": re.sub(r"\s+", " ", " ".join(ref.itertext())).strip()[:400]})
    abstracts = [a for a in root.iter() if _tag(a) == "abstract" and (a.get("abstract-type") or "") not in ("teaser", "graphical", "toc", "key-points", "summary")]
    plain = [a for a in abstracts if not a.get("abstract-type")] or abstracts
    if plain:
        best = max(plain, key=lambda a: len("".join(a.itertext())))
        parts = [": ".join(x for x in (next((re.sub(r"\s+", " ", "".join(t.itertext())).strip() for t in _children(s, "title", "head")), ""), " ".join(re.sub(r"\s+", " ", "".join(p.itertext())).strip() for p in s.iter() if _tag(p) == "p")) if x) for s in (_children(best, "sec", "div") or [best])]
        out.append(base | {"kind": "abstract", "text": " ".join(parts).strip()})
    body = next((e for e in root.iter() if _tag(e) == "body"), None)
    count = {"sec": 0}

    def walk(e: ET.Element, path: list[str]) -> None:
        title = next((re.sub(r"\s+", " ", "".join(t.itertext())).strip() for t in _children(e, "title", "head")), "")
        here = [*path, title] if title else path
        own, k = count["sec"], 0
        if any(_tag(c) in ("p", "sec", "div") for c in e):
            count["sec"] += bool(_children(e, "p"))
        for c in e:
            if _tag(c) == "p":
                cited, figs, tabs = [], [], []
                text = _flat(c, numbers, cited, figs, tabs).strip()
                if text:
                    out.append(base | {"kind": "paragraph", "sec_ord": own, "par_ord": k, "path": here, "text": text, "cited_keys": cited, "refs_figure": figs, "refs_table": tabs})
                    k += 1
            elif _tag(c) in ("sec", "div"):
                walk(c, here)

    if body is not None:
        walk(body, [])
    for n, f in enumerate(e for e in root.iter() if _tag(e) in ("table-wrap", "fig", "figure")):
        is_table = _tag(f) == "table-wrap" or f.get("type") == "table"
        words = [re.sub(r"\s+", " ", "".join(c.itertext())).strip() for name in ("head", "label", "caption", "figDesc") for c in _children(f, name)]
        grid = _rows(f) if is_table else []
        out.append(base | {"kind": "table" if is_table else "figure", "par_ord": n, "id": f.get("id") or f.get("{http://www.w3.org/XML/1998/namespace}id"), "text": ". ".join(dict.fromkeys(w.rstrip(".") for w in words if w)), "markdown": _markdown(grid)})
    return out


XML_ROWS = "paper_id string, kind string, sec_ord int, par_ord int, path array<string>, id string, text string, markdown string, cited_keys array<string>, refs_figure array<string>, refs_table array<string>"


def from_xml(papers: DataFrame) -> DataFrame:
    """parse_xml of every row (paper_id, xml), in batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for k, x in zip(b["paper_id"], b["xml"]) if isinstance(x, str) for r in parse_xml(k, x)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in XML_ROWS.split(", ")])
            for c in ("sec_ord", "par_ord"):
                out[c] = out[c].astype("Int32")
            yield out

    return papers.select("paper_id", "xml").mapInPandas(work, XML_ROWS)
