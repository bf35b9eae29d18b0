"""Word documents: paragraphs with runs out of .docx files, and .docx files out of ordered lists.

Files are read by Spark as binary and parsed with the standard library in Arrow batches;
styles are resolved within a file.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.batches import small_batches

#: Paragraphs of a batch that comes back, more only of a single file.
PARAGRAPHS = 2048
#: Tasks a core among which lists are dealt.
LISTS_TASKS = 4
# The WordprocessingML namespace, and fills that aren't highlights.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PLAIN_FILLS = ("ffffff", "auto", "none", "")

RUN = "struct<text string, bold boolean, italic boolean, underline string, highlight string, shading string, font_size_pt double, style string>"
PARAGRAPH = f"path string, idx int, style string, text string, runs array<{RUN}>"


def _fill(node: ET.Element | None, attribute: str) -> str | None:
    value = None if node is None else node.get(W + attribute)
    return value if value and value.lower() not in PLAIN_FILLS else None


def _flag(rpr: ET.Element | None, name: str) -> bool:
    node = None if rpr is None else rpr.find(W + name)
    return node is not None and node.get(W + "val", "true") not in ("0", "false", "off", "none")


def _marks(rpr: ET.Element | None) -> dict[str, str | None]:
    """Underline, highlight and shading as they are written; an absent underline isn't there at all."""
    if rpr is None:
        return {}
    out = {"highlight": _fill(rpr.find(W + "highlight"), "val"), "shading": _fill(rpr.find(W + "shd"), "fill")}
    if (u := rpr.find(W + "u")) is not None:
        out["underline"] = u.get(W + "val")
    return {k: v for k, v in out.items() if v is not None}


def styles_of(package: zipfile.ZipFile) -> tuple[dict[str, str], dict[str, dict]]:
    """Names of paragraph styles, and the marks of character styles, by style id."""
    try:
        root = ET.fromstring(package.read("word/styles.xml"))
    except (KeyError, ET.ParseError):
        return {}, {}
    names, marks = {}, {}
    for s in root.iter(W + "style"):
        key, kind = s.get(W + "styleId"), s.get(W + "type")
        name = s.find(W + "name")
        if key and kind == "paragraph" and name is not None:
            raw = name.get(W + "val") or key
            names[key] = raw.title() if raw.lower().startswith("heading ") else raw
        elif key and kind == "character":
            marks[key] = _marks(s.find(W + "rPr"))
    return names, marks


def _text(run: ET.Element) -> str:
    out = []
    for node in run:
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag == W + "tab":
            out.append("\t")
        elif node.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(content: bytes) -> list[dict]:
    """Every paragraph, empty ones too; a file that is no document gives none."""
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        body = ET.fromstring(package.read("word/document.xml")).find(W + "body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    names, inherited = styles_of(package)
    out = []
    for p in body.findall(W + "p") if body is not None else []:
        ppr = p.find(W + "pPr")
        style = None if ppr is None else ppr.find(W + "pStyle")
        key = None if style is None else style.get(W + "val")
        runs = []
        for r in p.iter(W + "r"):
            rpr = r.find(W + "rPr")
            own = None if rpr is None else rpr.find(W + "rStyle")
            run_style = None if own is None else own.get(W + "val")
            marks = inherited.get(run_style, {}) | _marks(rpr)  # what is written on the run wins
            line = marks.get("underline")
            size = None if rpr is None else rpr.find(W + "sz")
            half = None if size is None else size.get(W + "val")
            run = {
                "text": _text(r), "bold": _flag(rpr, "b"), "italic": _flag(rpr, "i"), "underline": None if line == "none" else line,
                "highlight": marks.get("highlight"), "shading": marks.get("shading"),
                "font_size_pt": int(half) / 2 if half and half.isdigit() else None, "style": run_style,
            }
            if any(run[k] for k in ("text", "bold", "italic", "underline", "highlight", "shading")):
                runs.append(run)
        out.append({"idx": len(out), "style": names.get(key, key) if key else names.get("Normal", "Normal"), "text": "".join(_text(r) for r in p.iter(W + "r")), "runs": runs})
    return out


def read_files(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = ("garbage",), skip_names: tuple[str, ...] = ()) -> DataFrame:
    """The .docx files below a folder, as binaryFile rows; whole files, so keep them small."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(root)
    parts = F.split("path", "/")
    return files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, skip_dirs))) & ~F.element_at(parts, -1).isin(*skip_names, ""))


def paragraphs(files: DataFrame) -> DataFrame:
    """``path, idx, style, text, runs`` of each paragraph."""
    small_batches(files.sparkSession)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = lambda rows: pd.DataFrame(rows, columns=["path", "idx", "style", "text", "runs"])
        for pdf in pdfs:
            rows: list[dict] = []
            for path, content in zip(pdf.path, pdf.content):
                rows += ({"path": path, **p} for p in parse_docx(content))
                if len(rows) >= PARAGRAPHS:
                    yield told(rows)
                    rows = []
            yield told(rows)

    return files.select("path", "content").mapInPandas(run, PARAGRAPH)


def as_jsonl(rows: DataFrame) -> DataFrame:
    """``path, jsonl``: the paragraphs of each file as JSON lines, in order; null fields are written."""
    line = F.to_json(F.struct(F.col("idx").alias("index"), "style", "text", "runs"), {"ignoreNullFields": "false"})
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("jsonl"))


def unreadable(files: DataFrame) -> DataFrame:
    """``path, error`` of the files that are no documents."""
    small_batches(files.sparkSession)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            bad = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    bad.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(bad, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, error string")


def manifest(files: DataFrame, rows: DataFrame, root: str, done: str) -> DataFrame:
    """``path, target, state``: files that gave rows (source_file) are to move below ``done`` with their sub-path; those that gave none stay."""
    name = F.element_at(F.split("path", "/"), -1)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root.removeprefix("file:").rstrip("/")) + "/*", "")
    got = rows.select(F.col("source_file").alias("_s")).distinct()
    out = files.select("path").join(got, name == F.col("_s"), "left")
    ok = F.col("_s").isNotNull()
    return out.select("path", F.when(ok, F.concat(F.lit(done.rstrip("/") + "/"), below)).alias("target"), F.when(ok, "parsed").otherwise("left").alias("state"))


def style_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("style").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "style")


def new_files(files: DataFrame, cards: DataFrame, analyticals: DataFrame, name_col: str = "source_file") -> DataFrame:
    """Files whose name no card and no analytical has."""
    known = cards.select(name_col).union(analyticals.select(name_col)).distinct()
    named = files.withColumn("_name", F.element_at(F.split("path", "/"), -1))
    return named.join(known, F.col("_name") == F.col(name_col), "left_anti").drop("_name")


def reingest(rows: DataFrame, again: DataFrame, fresh: DataFrame, name_col: str = "source_file") -> DataFrame:
    """Rows of the named files replaced by fresh ones."""
    return rows.join(again.select(name_col).distinct(), name_col, "left_anti").unionByName(fresh)


CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
DOC_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'


def _run_xml(text: str, bold: bool = False, line: bool = False, light: bool = False) -> str:
    marks = ("<w:b/>" if bold else "") + ('<w:highlight w:val="yellow"/>' if light else "") + ('<w:u w:val="single"/>' if line or light else "")
    return f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def marked_runs(text: str, spans: list[dict], bold: bool = False) -> str:
    """A run for each stretch between two ends of spans; a highlight is underlined too."""
    edges = sorted({0, len(text), *(s[k] for s in spans for k in ("start", "end") if 0 <= s[k] <= len(text))})
    out = []
    for a, b in zip(edges, edges[1:]):
        kinds = {s["kind"] for s in spans if s["start"] <= a and s["end"] >= b}
        out.append(_run_xml(text[a:b], bold, "underline" in kinds, "highlight" in kinds))
    return "".join(out)


def build_docx(entries: list[dict]) -> bytes:
    """A document of entries in order: headings (level, heading) that are new, then a card's or an argument's paragraphs."""
    body = []
    for e in entries:
        for level, heading in e.get("headings") or []:
            body.append(f'<w:p><w:pPr><w:pStyle w:val={quoteattr(f"Heading{level}")}/></w:pPr>{_run_xml(heading)}</w:p>')
        if e.get("argument") is not None:
            if e.get("answer_to"):
                body.append(f"<w:p>{_run_xml('AT: ' + e['answer_to'], bold=True)}</w:p>")
            body.append(f"<w:p>{marked_runs(e['argument'], e.get('markup') or [])}</w:p>")
            continue
        body.append(f"<w:p>{marked_runs(e.get('tag') or '', e.get('tag_markup') or [], bold=True)}</w:p>")
        body.append(f"<w:p>{_run_xml(e.get('cite_short') or '', bold=True)}</w:p>")
        if e.get("raw_cite"):
            body.append(f"<w:p>{_run_xml(e['raw_cite'])}</w:p>")
        body.append(f"<w:p>{marked_runs(e.get('card_text') or '', e.get('markup') or [])}</w:p>")
    ns = f'xmlns:w="{W[1:-1]}"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 10))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", RELS), ("word/_rels/document.xml.rels", DOC_RELS), ("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>"), ("word/document.xml", f"<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>")):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def export_lists(entries: DataFrame) -> DataFrame:
    """``workspace, content``: one document for each ordered list.

    ``entries``: workspace, position, headings (array of level, heading), tag, tag_markup,
    cite_short, raw_cite, card_text, argument, answer_to, markup.  A list is what one
    person reads aloud, so it fits a task.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("position").to_dict("records")
        as_list = lambda x: [] if x is None else [s if isinstance(s, dict) else s.asDict() for s in x]
        for r in rows:
            r["headings"] = [(h["level"], h["heading"]) for h in as_list(r["headings"])]
            r["markup"], r["tag_markup"] = as_list(r["markup"]), as_list(r["tag_markup"])
        return pd.DataFrame({"workspace": [pdf.workspace.iloc[0]], "content": [build_docx(rows)]})

    # building takes long for few bytes, by which adaptive execution would put all lists into a few tasks
    dealt = entries.repartition(LISTS_TASKS * entries.sparkSession.sparkContext.defaultParallelism, "workspace")
    return dealt.groupBy("workspace").applyInPandas(build, "workspace long, content binary")
