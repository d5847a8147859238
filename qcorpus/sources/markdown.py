"""Questions from Markdown files with a front matter: one row per question.

Files are read whole by Spark and parsed in Arrow batches, a file at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.settings import SettingsError, read_settings

SCHEMA = (
    "path string, front_matter map<string,string>, number int, question_text string, "
    "options array<struct<key:string,text:string>>, answer string, explanation string, topic string, error string"
)
_HEAD = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.S)
_QUESTION = re.compile(r"^#{1,3}\s*Question\s+(\d+)\s*$", re.M | re.I)
_OPTION = re.compile(r"^\s*[-*]\s+([A-Za-z])[.)]\s+(.*)$")
_FIELD = re.compile(r"^\*\*(Answer|Explanation|Topic):\*\*\s*(.*)$", re.I)


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all *.md files below ``folder`` but READMEs."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.where(~F.lower("path").rlike(r"/readme\.md$"))


def _front_matter(text: str) -> dict[str, str]:
    """Top-level settings as texts; maps and lists as JSON."""
    found = read_settings(text)
    if not isinstance(found, dict):
        raise SettingsError("front matter is no map")
    plain = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    return {k: plain(v) for k, v in found.items()}


def parse_block(block: str) -> dict[str, object]:
    """Text, options and labelled fields of one question; a field runs on to the next."""
    found: dict[str, object] = {"options": []}
    lines: dict[str, list[str]] = {"question_text": []}
    at, fenced = "question_text", False
    for line in block.splitlines():
        fenced ^= line.lstrip().startswith("```")
        field = None if fenced else _FIELD.match(line)
        option = None if fenced or at != "question_text" else _OPTION.match(line)
        if field:
            at = field[1].lower()
            lines[at] = [field[2]]
        elif option:
            found["options"].append({"key": option[1].upper(), "text": option[2].strip()})
        else:
            lines[at].append(line)
    return found | {k: "\n".join(v).strip() or None for k, v in lines.items()}


_ARROW = pa.schema([
    ("path", pa.string()), ("front_matter", pa.map_(pa.string(), pa.string())), ("number", pa.int32()), ("question_text", pa.string()),
    ("options", pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())]))), ("answer", pa.string()), ("explanation", pa.string()),
    ("topic", pa.string()), ("error", pa.string()),
])


def file_questions(path: str, content: str | None) -> list[dict[str, object]]:
    head = _HEAD.match(content or "")
    if not head:
        return [{"path": path, "error": "no front matter"}]
    try:
        fields = list(_front_matter(head[1]).items())
    except SettingsError as e:
        return [{"path": path, "error": f"front matter: {e}"}]
    parts = _QUESTION.split(content[head.end() :])
    if len(parts) < 3:
        return [{"path": path, "front_matter": fields, "error": "no question"}]
    return [{"path": path, "front_matter": fields, "number": int(n)} | parse_block(block) for n, block in zip(parts[1::2], parts[2::2])]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [q for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))) for q in file_questions(path, content)]
        yield from pa.Table.from_pylist(rows, _ARROW).to_batches()


def parse_markdown(files: DataFrame) -> DataFrame:
    """One row per question of (path, content) files; files that cannot be read give a row with ``error``."""
    return files.select("path", "content").mapInArrow(_parse, SCHEMA)
