"""Word-processor packages as a source and a sink: records, table cells, picture references; and packages written back with
replacements in their text runs. Parsing uses the standard library alone and runs where the packages are."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve import fixed

# XML namespaces of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_CP = "{http://schemas.openxmlformats.org/officeDocument/2006/custom-properties}"
_VT = "{http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_CUSTOM = "docProps/custom.xml"
_CUSTOM_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/custom-properties"
_CUSTOM_TYPE = "application/vnd.openxmlformats-officedocument.custom-properties+xml"
_FORMAT = "{D5CDD505-2E9C-101B-9397-08002B2CF9AE}"
_LAYOUT = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
_TEXT = {f"{_W}t", f"{_W}instrText"}
_ORDER = ("word/document.xml", "word/header", "word/footer", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml")

#: Limits on packages from outside.
MAX_BYTES, MAX_EXPANDED, MAX_MEMBERS = 25 << 20, 200 << 20, 10_000


def check(name: str, content: bytes) -> str | None:
    """What is wrong with a package, None for nothing."""
    if not name.lower().endswith(".docx"):
        return "extension"
    if not content:
        return "empty"
    if len(content) > MAX_BYTES:
        return "too_large"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            names = [i.filename for i in infos]
            problems = (
                (len(infos) > MAX_MEMBERS, "too_many_members"),
                (sum(i.file_size for i in infos) > MAX_EXPANDED, "expands_too_far"),
                (len(set(names)) != len(names), "duplicate_members"),
                (any(i.flag_bits & 1 for i in infos), "encrypted"),
                ("word/document.xml" not in names, "no_document"),
            )
            for wrong, code in problems:
                if wrong:
                    return code
            return "bad_member" if z.testzip() else None
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
        return "not_a_package"


@dataclass
class Paragraph:
    """A paragraph of a part: its own text nodes (not those of paragraphs inside it) and where in a table it stands."""

    element: ET.Element
    nodes: list[ET.Element]
    cell: tuple[int, int, int] | None
    headers: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(map(node_text, self.nodes))

    def offsets(self) -> Iterator[tuple[ET.Element, int, int]]:
        at = 0
        for n in self.nodes:
            size = len(node_text(n))
            yield n, at, at + size
            at += size


def node_text(node: ET.Element) -> str:
    return _LAYOUT.get(node.tag, node.text or "")


def _all_text(element: ET.Element) -> str:
    return "".join(node_text(n) for n in element.iter() if n.tag in _TEXT or n.tag in _LAYOUT)


def _flat(element: ET.Element) -> str:
    return re.sub(r"\s+", " ", _all_text(element)).strip()


class Package:
    """An open package; parts with text are parsed, others stay bytes."""

    def __init__(self, content: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.members = {i.filename: z.read(i) for i in z.infolist()}
        if "word/document.xml" not in self.members:
            raise ValueError("the package has no word/document.xml")
        for data in self.members.values():
            for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]) if data[:5] == b"<?xml" and b"<!ENTITY" not in data else ():
                if not re.fullmatch(r"ns\d+", prefix):
                    ET.register_namespace(prefix, uri)
        names = sorted((n for n in self.members if re.match(fixed.TEXT_PART, n)), key=lambda n: (next(i for i, p in enumerate(_ORDER) if n.startswith(p)), n))
        if any(b"<!ENTITY" in self.members[n] for n in names):
            raise ValueError("the package declares entities")
        self.parts = {n: ET.fromstring(self.members[n]) for n in names}

    def tables(self) -> Iterator[tuple[str, int, list[list[ET.Element]]]]:
        for part, root in self.parts.items():
            for i, table in enumerate(root.iter(f"{_W}tbl")):
                yield part, i, [[c for c in row if c.tag == f"{_W}tc"] for row in table if row.tag == f"{_W}tr"]

    def paragraphs(self) -> Iterator[tuple[str, Paragraph]]:
        """Paragraphs that hold text nodes, in order, with their innermost cell."""
        place, heads = {}, {}
        for part, i, rows in self.tables():
            heads[part, i] = [_flat(c) for c in rows[0]] if rows else []
            for r, row in enumerate(rows):
                for c, cell in enumerate(row):
                    place[id(cell)] = (i, r, c)

        def walk(element: ET.Element, cell: tuple | None, owner: Paragraph | None) -> Iterator[Paragraph]:
            for child in element:
                if child.tag == f"{_W}p":
                    inner = Paragraph(child, [], cell)
                    later = list(walk(child, cell, inner))
                    yield inner
                    yield from later
                    continue
                if owner is not None and (child.tag in _TEXT or child.tag in _LAYOUT):
                    owner.nodes.append(child)
                yield from walk(child, place.get(id(child), cell) if child.tag == f"{_W}tc" else cell, owner)

        for part, root in self.parts.items():
            for p in walk(root, None, None):
                if any(n.tag in _TEXT for n in p.nodes):
                    p.headers = heads.get((part, p.cell[0]), []) if p.cell else []
                    yield part, p

    def pictures(self, around: int = 2) -> Iterator[dict]:
        """Embedded pictures with the text near them; external targets and missing media are left out."""
        for part, root in self.parts.items():
            rels = self.members.get(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
            if not rels:
                continue
            target = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(rels) if r.get("TargetMode") != "External" and r.get("Type", "").endswith("/image")}
            paragraphs = list(root.iter(f"{_W}p"))
            texts = [_all_text(p).strip() for p in paragraphs]
            for i, p in enumerate(paragraphs):
                said = dict.fromkeys(v for d in p.iter(f"{_WP}docPr") for v in (d.get("name"), d.get("descr"), d.get("title")) if v)
                for blip in p.iter(f"{_A}blip"):
                    path = posixpath.normpath(posixpath.join(posixpath.dirname(part), target.get(blip.get(f"{_R}embed"), "")))
                    if target.get(blip.get(f"{_R}embed")) and path in self.members:
                        yield {"part_name": part, "media_path": path, "paragraph_index": i, "nearby_text": "\n".join(filter(None, texts[max(0, i - around) : i + around + 1])), "description": " ".join(said), "content": self.members[path]}

    @property
    def done(self) -> bool:
        """Whether the package carries the mark of an earlier run."""
        try:
            root = ET.fromstring(self.members.get(_CUSTOM, b"<x/>"))
        except ET.ParseError:
            return False
        return any(p.get("name") == fixed.DONE_PROPERTY for p in root)

    def replace(self, replacements: dict[str, list[tuple[int, int, str]]]) -> None:
        """Replacements by record id. The new text goes into the first run that a span touches; a span over a tab or a line
        break is an error, as is one outside of its record."""
        seen: dict[str, int] = {}
        for part, p in self.paragraphs():
            n = seen[part] = seen.get(part, -1) + 1
            nodes = list(p.offsets())
            for start, end, new in sorted(replacements.get(record_id(part, n), ()), reverse=True):
                hit = [x for x in nodes if x[1] < end and start < x[2]]
                if not hit or start < 0 or end > nodes[-1][2]:
                    raise ValueError(f"span {start}-{end} lies outside of {record_id(part, n)}")
                if any(x[0].tag in _LAYOUT for x in hit):
                    raise ValueError(f"span {start}-{end} crosses a tab or line break in {record_id(part, n)}")
                for i, (node, a, _) in enumerate(hit):
                    old = node.text or ""
                    node.text = (old[: start - a] + new if i == 0 else "") + (old[end - a :] if i == len(hit) - 1 else "")
                    if node.text[:1].isspace() or node.text[-1:].isspace():
                        node.set(_SPACE, "preserve")
                    else:
                        node.attrib.pop(_SPACE, None)

    def mark(self) -> None:
        """Puts the mark of a run into the custom properties, with its relationship and content type."""
        root = ET.fromstring(self.members[_CUSTOM]) if _CUSTOM in self.members else ET.Element(f"{_CP}Properties")
        found = next((p for p in root if p.get("name") == fixed.DONE_PROPERTY), None)
        if found is None:
            highest = max((int(p.get("pid", "1")) for p in root), default=1)
            found = ET.SubElement(root, f"{_CP}property", {"fmtid": _FORMAT, "pid": str(highest + 1), "name": fixed.DONE_PROPERTY})
        for child in list(found):
            found.remove(child)
        ET.SubElement(found, f"{_VT}lpwstr").text = fixed.DONE_VERSION
        self.members[_CUSTOM] = _xml(root)
        if "_rels/.rels" in self.members:
            rels = ET.fromstring(self.members["_rels/.rels"])
            if not any(r.get("Type") == _CUSTOM_REL for r in rels):
                used = {r.get("Id") for r in rels}
                free = next(f"rId{i}" for i in range(1, len(used) + 2) if f"rId{i}" not in used)
                ET.SubElement(rels, f"{_REL}Relationship", {"Id": free, "Type": _CUSTOM_REL, "Target": _CUSTOM})
                self.members["_rels/.rels"] = _xml(rels)
        if "[Content_Types].xml" in self.members:
            types = ET.fromstring(self.members["[Content_Types].xml"])
            if not any(t.get("PartName") == f"/{_CUSTOM}" for t in types):
                ET.SubElement(types, f"{_CT}Override", {"PartName": f"/{_CUSTOM}", "ContentType": _CUSTOM_TYPE})
                self.members["[Content_Types].xml"] = _xml(types)

    def content(self) -> bytes:
        """The package as bytes, members in their old order."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for name, data in self.members.items():
                z.writestr(name, _xml(self.parts[name]) if name in self.parts else data)
        return out.getvalue()


def _xml(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def record_id(part: str, n: int) -> str:
    return f"{part}:p{n:06d}"


RECORDS = "doc_id string, record_id string, part_name string, ord long, text string, cell_key string, table_headers array<string>, column_header string, nodes array<struct<node_idx:int,start:int,end:int,hard_boundary:boolean>>, boundaries array<struct<start:int,end:int>>"
CELLS = "doc_id string, part_name string, table_id string, row int, col int, cell string"
PICTURES = "doc_id string, part_name string, media_path string, paragraph_index int, nearby_text string, description string, content binary"


def packages(spark: SparkSession, path: str) -> DataFrame:
    """path, content, error and is_redacted of the files under a path. Packages with an error are for quarantine."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["error"] = [check(p, bytes(c)) for p, c in zip(df["path"], df["content"], strict=True)]
            df["is_redacted"] = [e is None and Package(bytes(c)).done for c, e in zip(df["content"], df["error"], strict=True)]
            yield df

    return files.mapInPandas(run, "path string, content binary, error string, is_redacted boolean")


def _parsed(files: DataFrame, rows_of, schema: str) -> DataFrame:  # noqa: ANN001
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                yield pd.DataFrame([{"doc_id": path, **r} for r in rows_of(Package(bytes(content)))], columns=names)

    usable = files.where("error IS NULL") if "error" in files.columns else files
    return usable.select("path", "content").mapInPandas(run, schema)


def records(files: DataFrame) -> DataFrame:
    """One row for each paragraph with text nodes: its text with tabs and breaks, text nodes with offsets, hard boundaries, and
    its cell, table headers and column header."""

    def rows(package: Package) -> Iterator[dict]:
        seen: dict[str, int] = {}
        for ord_, (part, p) in enumerate(package.paragraphs()):
            n = seen[part] = seen.get(part, -1) + 1
            nodes = [{"node_idx": i, "start": a, "end": b, "hard_boundary": e.tag in _LAYOUT} for i, (e, a, b) in enumerate(p.offsets())]
            key = f"{part}:t{p.cell[0]:04d}:r{p.cell[1]:04d}:c{p.cell[2]:03d}" if p.cell else None
            header = p.headers[p.cell[2]] if p.cell and p.cell[2] < len(p.headers) else ""
            yield {"record_id": record_id(part, n), "part_name": part, "ord": ord_, "text": p.text, "cell_key": key, "table_headers": p.headers, "column_header": header, "nodes": nodes, "boundaries": [{"start": x["start"], "end": x["end"]} for x in nodes if x["hard_boundary"]]}

    return _parsed(files, rows, RECORDS)


def cells(files: DataFrame) -> DataFrame:
    """One row for each table cell; cells of inner tables are also part of the outer cell's text."""

    def rows(package: Package) -> Iterator[dict]:
        for part, i, table in package.tables():
            for r, row in enumerate(table):
                for c, cell in enumerate(row):
                    yield {"part_name": part, "table_id": f"{part}:t{i:04d}", "row": r, "col": c, "cell": _flat(cell)}

    return _parsed(files, rows, CELLS)


def pictures(files: DataFrame) -> DataFrame:
    """One row for each reference to an embedded picture."""
    return _parsed(files, lambda package: package.pictures(), PICTURES)


def rewrite(files: DataFrame, detections: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """path, content of new packages: replacements (doc_id, record_id, start, end, replacement) written into the runs, pictures
    to replace (doc_id, media_path, new_content) exchanged, the mark set."""
    by_doc = detections.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("record_id", "start", "end", "replacement")).alias("spans"))
    rows = files.select("path", "content").join(by_doc, "path", "left")
    media = images.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("media_path", "new_content")).alias("media")) if images is not None else None
    rows = rows.join(media, "path", "left") if media is not None else rows.withColumn("media", F.lit(None).cast("array<struct<media_path:string,new_content:binary>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for _, row in df.iterrows():
                package, todo = Package(bytes(row["content"])), {}
                for s in () if row["spans"] is None else row["spans"]:
                    todo.setdefault(s["record_id"], []).append((s["start"], s["end"], s["replacement"]))
                package.replace(todo)
                for m in () if row["media"] is None else row["media"]:
                    package.members[m["media_path"]] = bytes(m["new_content"])
                package.mark()
                out.append((row["path"], package.content()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")
