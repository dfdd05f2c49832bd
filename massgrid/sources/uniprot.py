"""UniProt text records: scan, parse, isoforms, and writing records again.

The text source cuts files at the record end, so large plain files are split over tasks; .gz files and globs work as
in any Spark source. Parsing is plain Python on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massgrid.operators.build import protein_bytes
from massgrid.shared import written
from massgrid.sources.files import numbered

RECORD_END = "\n//\n"
#: Line codes of a record, in the order in which they are written.
CODES = "ID AC DT DE GN OS OG OC OX OH RN RP RC RX RG RA RT RL CC DR PE KW FT SQ".split()
#: Bytes of a file whose records one task fetches.
INDEX_STRETCH = 64 << 20
SKIPPED = ("Displayed", "External", "Not described")


class RecordError(ValueError):
    pass


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value) a row for each record, without its end line. A last record without an end line is dropped."""
    rows = spark.read.text(path, lineSep=RECORD_END).where(_whole("value") != "none")
    return rows.select(F.regexp_replace("value", r"^(?:\s*\n)+", "").alias("value"))


def _whole(value: str) -> F.Column:
    """How a piece between end marks ends: "cut" at its end mark, "own" with an end line that no break follows, "none" if it is no whole record.

    A whole record has a sequence header; what follows the last end mark is blank or cut off.
    """
    body = F.regexp_replace(value, r"^(?:\s*\n)+", "")
    return F.when(body.rlike(r"(?s)^ID .*\n//\s*$"), "own").when(body.rlike(r"(?s)^ID .*\nSQ "), "cut").otherwise("none")


def record_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(accession, file, start, size): where the bytes of each record lie in plain text files, its end line included.

    Files are read in splits by many tasks. A record's place is the sum of the bytes before it: those of its split, in the
    order in which they were read, and those of the splits before in its file. Records are not parsed.
    """
    rows = spark.read.text(path, lineSep=RECORD_END).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.select("file", "split", "at", F.octet_length("value").cast("long").alias("body"), F.octet_length(F.regexp_extract("value", r"^(?:\s*\n)*", 0)).alias("blank"), F.regexp_extract("value", r"(?m)^AC   ([^;\n]*);", 1).alias("accession"), _whole("value").alias("whole"))
    sizes = written(sizes.withColumn("bytes", F.col("body") + len(RECORD_END)), "record-sizes")
    splits = sizes.groupBy("file", "split").agg(F.sum("bytes").alias("total"))  # a row for each split
    ahead = splits.select("file", "split", (F.sum("total").over(Window.partitionBy("file").orderBy("split")) - F.col("total")).alias("before"))
    inside = F.sum("bytes").over(Window.partitionBy("file", "split").orderBy("at")) - F.col("bytes")
    placed = sizes.withColumn("inside", inside).join(ahead, ["file", "split"])
    ended = F.when(F.col("whole") == "cut", len(RECORD_END)).otherwise(0)  # the other kind has its end line within
    return placed.where(F.col("whole") != "none").select(F.trim("accession").alias("accession"), "file", (F.col("before") + F.col("inside") + F.col("blank")).alias("start"), (F.col("body") - F.col("blank") + ended).alias("size"))


def read_records(index: DataFrame) -> DataFrame:
    """(accession, value, bytes) of the records of an index, each fetched by its range of bytes; nothing else is read.

    Ranges of a file are fetched in order. Files must be in a store that pyarrow can open.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[str, object] = {}
        for frame in frames:
            values = []
            for file, start, size in zip(frame["file"], frame["start"], frame["size"], strict=True):
                if file not in opened:
                    for old in opened.values():
                        old.close()
                    store, path = pafs.FileSystem.from_uri(file)
                    opened = {file: store.open_input_file(path)}
                values.append(opened[file].read_at(size, start).decode("utf-8", "replace"))
            yield pd.DataFrame({"accession": frame["accession"], "value": values, "bytes": frame["size"]})

    return index.repartition("file", F.floor(F.col("start") / INDEX_STRETCH)).sortWithinPartitions("file", "start").mapInPandas(run, "accession string, value string, bytes long")


def fields(record: str) -> dict[str, str]:
    """Text by line code, lines kept; the sequence is under `sequence`, without blanks."""
    out: dict[str, list[str]] = {}
    residues: list[str] = []
    for line in record.split("\n"):
        if not line.strip() or line.startswith("**") or line == "//":
            continue
        code = line[:2]
        if code == "  ":
            residues.append(line.replace(" ", ""))
        elif code in CODES:
            out.setdefault(code, []).append(line[5:])
        else:
            raise RecordError(f"unknown line code {code!r}")
    if "ID" not in out:
        raise RecordError("a record starts with an ID line")
    return {k: "\n".join(v) for k, v in out.items()} | {"sequence": "".join(residues)}


def from_bytes(data: bytes) -> dict[str, str]:
    """One whole record: starts with ID, ends with its end line."""
    text = data.decode("utf-8", "replace")
    if not text.startswith("ID") or not text.endswith("//\n"):
        raise RecordError("not one whole record")
    return fields(text)


def write(record: dict[str, str]) -> str:
    """The text of a record: 60 residues on a line, in blocks of ten."""
    lines = [f"{c}   {line}" for c in CODES if c in record for line in record[c].split("\n")]
    s = record.get("sequence", "")
    for i in range(0, len(s), 60):
        lines.append("     " + " ".join(s[k : k + 10] for k in range(i, min(i + 60, len(s)), 10)))
    return "\n".join([*lines, "//"])


def accession(ac: str) -> str:
    return ac.split(";", 1)[0].strip()


def genes(gn: str) -> list[str]:
    """All gene names; evidence in braces is dropped, commas in it do not split."""
    out = []
    for group in gn.replace("\n", "").split(";"):
        text = group.strip().split("=", 1)[-1]
        depth, plain = 0, []
        for c in text:
            depth += (c == "{") - (c == "}" and depth > 0)
            if not depth and c != "}":
                plain.append(c)
        out += [g.strip() for g in "".join(plain).split(",") if g.strip()]
    return out


def taxonomy_id(ox: str) -> int:
    m = re.search(r"NCBI_TaxID=(\d+)", ox)
    if not m:
        raise RecordError("no taxonomy id")
    return int(m[1])


@dataclass(frozen=True)
class Feature:
    key: str
    isoform: str | None
    start: tuple[str, int | None]
    end: tuple[str, int | None]
    qualifiers: dict[str, str]

    def operation(self) -> tuple[str, str, str]:
        """("missing" | "replace" | "other", from, to), without the explanation in parentheses."""
        note = self.qualifiers.get("note", "").strip()
        if note.endswith(")") and "(" in note:
            note = note[: note.index("(")].rstrip()
        if note == "Missing":
            return "missing", "", ""
        if "->" in note:
            a, b = note.split("->", 1)
            return "replace", "".join(a.split()), "".join(b.split())
        return "other", note, ""


def place(text: str) -> tuple[str, int | None]:
    """A number, one before or after it, an uncertain one, or unknown."""
    if text == "?":
        return "unknown", None
    kinds = {"?": "uncertain", "<": "before", ">": "after"}
    try:
        return (kinds[text[0]], int(text[1:])) if text[:1] in kinds else ("fix", int(text))
    except ValueError:
        raise RecordError(f"no position: {text!r}") from None


def features(ft: str) -> list[Feature]:
    """The feature table: a header line each, and quoted qualifiers that may run over lines."""
    out: list[Feature] = []
    name = None
    for line in ft.split("\n"):
        if line and not line[0].isspace():
            key, where = line.split()[:2]
            isoform, _, span = where.rpartition(":")
            a, _, b = span.partition("..")
            out.append(Feature(key, isoform or None, place(a), place(b or a), {}))
            name = None
        elif out and line.strip().startswith("/") and (m := re.match(r"\s*/(\w+)=(.*)", line)):
            name = m[1]
            out[-1].qualifiers[name] = m[2].strip()
        elif out and name:
            out[-1].qualifiers[name] += " " + line.strip()
    return [Feature(f.key, f.isoform, f.start, f.end, {k: v.strip().strip("\"") for k, v in f.qualifiers.items()}) for f in out]


def alternative_products(cc: str) -> list[tuple[str, list[str], list[str]]]:
    """(name, isoform ids, feature ids) of the isoforms that differ from the shown sequence by features."""
    lines = cc.split("\n")
    head = "-!- ALTERNATIVE PRODUCTS:"
    if head not in lines:
        return []
    body = []
    for line in lines[lines.index(head) + 1 :]:
        if not line[:1].isspace():
            break
        body.append(line)
    listed = lambda v: [x.strip() for x in v.split(",") if x.strip()]
    out, name, ids = [], None, []
    for field in " ".join(body).split(";"):
        key, _, value = field.strip().partition("=")
        value = value.strip()
        if key == "Name":
            name, ids = value, []
        elif key == "IsoId":
            ids = listed(value)
        elif key == "Sequence" and name is not None:
            if value not in SKIPPED:
                out.append((name, ids, listed(value)))
            name = None
    return out


def edited(sequence: str, edits: list[Feature]) -> str:
    """The sequence with missing and replaced stretches. Edits must not overlap and must fit the sequence."""
    out, at = [], 0
    spans = []
    for f in edits:
        kind, old, new = f.operation()
        if kind == "other":
            continue
        if f.start[0] not in ("fix", "before") or f.end[0] not in ("fix", "after"):
            raise RecordError(f"uncertain place of {f.qualifiers.get('id', f.key)}")
        spans.append((1 if f.start[0] == "before" else f.start[1], len(sequence) if f.end[0] == "after" else f.end[1], kind, old, new))
    for start, end, kind, old, new in sorted(spans):
        if start - 1 < at:
            raise RecordError(f"edits overlap at {start}")
        if end > len(sequence):
            raise RecordError(f"{end} is beyond the sequence")
        if kind == "replace" and sequence[start - 1 : end] != old:
            raise RecordError(f"{sequence[start - 1 : end]!r} stands where {old!r} should")
        out += [sequence[at : start - 1], new]
        at = end
    return "".join([*out, sequence[at:]])


def variants(record: dict[str, str]) -> list[dict]:
    """The shown protein, then its isoforms that have edits."""
    base = {
        "accession": accession(record.get("AC", "")),
        "sequence": record["sequence"].upper(),
        "taxonomy_id": taxonomy_id(record.get("OX", "")),
        "is_reviewed": "Reviewed" in record["ID"],
        "genes": genes(record.get("GN", "")),
    }
    edits = {f.qualifiers["id"]: f for f in features(record.get("FT", "")) if f.key == "VAR_SEQ" and "id" in f.qualifiers}
    out = [base]
    for name, ids, wanted in alternative_products(record.get("CC", "")):
        own = [edits[x] for x in wanted if x in edits and edits[x].operation()[0] != "other"]
        if own:
            if not ids:
                raise RecordError(f"isoform {name} has no id")
            out.append(base | {"accession": ids[0], "sequence": edited(base["sequence"], own)})
    return out


PROTEIN = "accession string, sequence string, taxonomy_id int, is_reviewed boolean, genes array<string>"


def proteins(records: DataFrame, strict: bool = True) -> DataFrame:
    """Proteins and isoforms of scanned records; strict=False leaves faulty records out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["value"]:
                try:
                    rows += variants(fields(text))
                except RecordError:
                    if strict:
                        raise
            yield pd.DataFrame(rows, columns=["accession", "sequence", "taxonomy_id", "is_reviewed", "genes"])

    return records.mapInPandas(run, PROTEIN)


def with_ids(rows: DataFrame) -> DataFrame:
    """Adds id: unique and increasing in the order of reading, without a shuffle; the numbers may have gaps."""
    return rows.select(F.monotonically_increasing_id().alias("id"), *rows.columns)


#: The least id of a table that is numbered without gaps.
FIRST_ID = -(1 << 31)


def loaded(rows: DataFrame, start: int = FIRST_ID) -> DataFrame:
    """Adds id: consecutive numbers by accession, so that the same proteins get the same ids however they were read."""
    return numbered(rows, "accession", "sequence", start=start).withColumnRenamed("n", "id").select("id", *rows.columns)


def load_counts(rows: DataFrame) -> DataFrame:
    """(proteins, bytes) of a load."""
    return rows.agg(F.count("*").alias("proteins"), F.coalesce(F.sum(protein_bytes()), F.lit(0)).alias("bytes"))
