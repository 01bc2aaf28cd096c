"""Turtle documents in full: statements over lines, lists with ; and , and [], @base, numbers and long strings.

A document can't be split, as what stands in it depends on all before. Each file is read by
one task, statement by statement; files are spread over the tasks. Documents of one triple a
line, however large, are better read by loomgraph.sources.text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX\b|BASE\b)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:[0-9]+\.?[0-9]*[eE][+-]?[0-9]+|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
    |(?P<word>true\b|false\b|a(?=[\s<\[(]))
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    """A document that breaks the grammar; the message has the line."""


def _unescaped(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text)


def _quoted(text: str) -> str:
    """A literal in the canonical form: on one line, with quotes."""
    body = text[3:-3] if text[:3] in ('"""', "'''") and len(text) >= 6 else text[1:-1]
    value = _unescaped(body)
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


class _Document:
    def __init__(self, text: str, mark: str):
        self.text, self.at, self.kind, self.value = text, 0, "", ""
        self.mark, self.blanks = mark, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[tuple[str, str, str]] = []
        self.take()

    def fail(self, what: str) -> TurtleError:
        return TurtleError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    def take(self) -> str:
        """The token at hand; the next one comes to hand."""
        value = self.value
        while self.at < len(self.text):
            m = TOKEN.match(self.text, self.at)
            if not m:
                raise self.fail(f"unexpected {self.text[self.at:self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return value
        self.kind, self.value = "end", ""
        return value

    def expect(self, mark: str) -> None:
        if self.value != mark:
            raise self.fail(f"expected {mark!r}, found {self.value!r}")
        self.take()

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.mark}n{self.blanks}"

    def iri(self) -> str:
        if self.kind == "iri":
            return urljoin(self.base, _unescaped(self.take()[1:-1])) if self.base else _unescaped(self.take()[1:-1])
        if self.kind != "name":
            raise self.fail(f"expected an IRI, found {self.value!r}")
        name, _, local = self.take().partition(":")
        if name not in self.prefixes:
            raise self.fail(f"prefix {name}: isn't declared")
        return self.prefixes[name] + re.sub(r"\\(.)", r"\1", local)

    def node(self) -> str:
        """A subject or an object."""
        if self.kind in ("iri", "name"):
            return self.iri()
        if self.kind == "blank":
            return f"_:{self.mark}{self.take()[2:]}"
        if self.value == "[":
            self.take()
            own = self.fresh()
            if self.value != "]":
                self.properties(own)
            self.expect("]")
            return own
        if self.value == "(":
            self.take()
            items = []
            while self.value != ")":
                if self.kind == "end":
                    raise self.fail("a list isn't closed")
                items.append(self.node())
            self.take()
            rest = RDF + "nil"
            for item in reversed(items):
                own = self.fresh()
                self.out += [(own, RDF + "first", item), (own, RDF + "rest", rest)]
                rest = own
            return rest
        if self.kind == "text":
            value = _quoted(self.take())
            if self.kind == "lang":
                return value + self.take()
            if self.value == "^^":
                self.take()
                return f"{value}^^<{self.iri()}>"
            return value
        if self.kind == "number":
            value = self.take()
            return f'"{value}"^^<{XSD}{"double" if "e" in value.lower() else "decimal" if "." in value else "integer"}>'
        if self.value in ("true", "false"):
            return f'"{self.take()}"^^<{XSD}boolean>'
        raise self.fail(f"expected a term, found {self.value!r}")

    def properties(self, subject: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.take()
                predicate = RDF + "type"
            else:
                predicate = self.iri()
            while True:
                self.out.append((subject, predicate, self.node()))
                if self.value != ",":
                    break
                self.take()
            if self.value != ";":
                return
            while self.value == ";":
                self.take()
            if self.value in (".", "]"):
                return

    def statements(self) -> Iterator[list[tuple[str, str, str]]]:
        while self.kind != "end":
            if self.kind == "directive":
                word = self.take()
                if word.lower().lstrip("@") == "prefix":
                    if self.kind != "name" or not self.value.endswith(":"):
                        raise self.fail(f"expected a prefix, found {self.value!r}")
                    name = self.take()[:-1]
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                if word.startswith("@"):
                    self.expect(".")
                continue
            bare = self.value == "["
            subject = self.node()
            if not (bare and self.value == "."):
                self.properties(subject)
            self.expect(".")
            done, self.out = self.out, []
            yield done


def parse(text: str, mark: str = "") -> list[tuple[str, str, str]]:
    """The triples of a document, in canonical form; mark goes before its blank nodes' names."""
    return [t for s in _Document(text, mark).statements() for t in s]


def documents(files: DataFrame) -> DataFrame:
    """s, p, o of files (path, value: the whole document). Blank nodes are told apart by file; a document that breaks the grammar ends the query."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for mark, path, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows: list[tuple[str, str, str]] = []
                try:
                    for statement in _Document(text or "", mark).statements():
                        rows += statement
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["s", "p", "o"])
                            rows = []
                except TurtleError as e:
                    raise TurtleError(f"{path}: {e}") from None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["s", "p", "o"])

    mark = F.concat(F.lit("f"), F.lower(F.hex(F.xxhash64("path"))))
    return files.select(mark.alias("mark"), F.col("path").cast("string"), F.col("value").cast("string")).mapInArrow(run, "s string, p string, o string")


def read_turtle_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole Turtle files of a folder or pattern; a file is one task's, and fits in its memory."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return documents(files)
