"""API symbols of source files: Python by its own grammar, Go, Rust and TypeScript by brackets and statements (``declarations``)."""

from __future__ import annotations

import ast
import inspect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.lineage import spread
from . import markdown
from .declarations import Symbol, capped, go, go_module, rust, rust_module, typescript

SCHEMA = "package string, file string, line int, kind string, name string, path string, sig string, doc string, alias_of string"
MAX_SOURCE = 3 << 20


def python(text: str) -> Iterator[Symbol]:
    """Classes, functions and methods without a leading underscore (but ``__init__`` and ``__call__``); decorators are in signatures."""

    def walk(body: list[ast.stmt], up: str) -> Iterator[Symbol]:
        for node in body:
            if isinstance(node, (ast.If, ast.Try)):
                yield from walk(node.body, up)
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or node.name.startswith("_") and not (up and node.name in ("__init__", "__call__")):
                continue
            marks = "".join(f"@{ast.unparse(d)} " for d in node.decorator_list)
            doc = capped(inspect.cleandoc(ast.get_docstring(node, clean=False) or ""))
            path = f"{up}.{node.name}" if up else node.name
            if isinstance(node, ast.ClassDef):
                bases = ", ".join(ast.unparse(b) for b in [*node.bases, *node.keywords])
                yield node.lineno, "class", node.name, path, f"{marks}class {node.name}" + (f"({bases})" if bases else ""), doc, None
                yield from walk(node.body, path)
            else:
                returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
                yield node.lineno, "method" if up else "function", node.name, path, f"{marks}{word} {node.name}({ast.unparse(node.args)}){returns}", doc, None

    yield from walk(ast.parse(text).body, "")


PARSERS = {"python": python, "go": go, "rust": rust, "ts": typescript}


def symbols(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` from source files (``package, file, how, text``) up to MAX_SOURCE bytes; broken files give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for package, file, how, text in zip(frame.package, frame.file, frame.how, frame.text, strict=True):
                try:
                    own = typescript(text or "", file or "") if how == "ts" else PARSERS[how](text or "")
                    rows += [(package, file, *s) for s in own]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["package", "file", "line", "kind", "name", "path", "sig", "doc", "alias_of"])

    usable = files.filter(F.col("how").isin(*PARSERS) & (F.octet_length("text") <= MAX_SOURCE))
    return spread(usable.select("package", "file", "how", "text"), compact=True).mapInPandas(run, SCHEMA)


def module_doc(how: str, package: str, file: str, text: str) -> tuple[int, str, str]:
    """What a source file says about its module: line, title and text, which is empty if it says nothing."""
    folder = file.rpartition("/")[0]
    if how == "go":
        line, doc, name = go_module(text)
        return line, f"package {name} ({folder})" if folder else f"package {name}", doc
    if how == "rust":
        steps = file.removeprefix("src/").removesuffix(".rs").split("/")
        line, doc = rust_module(text)
        return line, "::".join([package.replace("-", "_"), *(steps[:-1] if steps[-1] in ("mod", "lib", "main") else steps)]), doc
    tree = ast.parse(text)
    doc = inspect.cleandoc(ast.get_docstring(tree, clean=False) or "")
    return tree.body[0].lineno if doc else 1, file.removesuffix(".pyi").removesuffix(".py").removesuffix("/__init__").replace("/", "."), doc


def module_docs(files: DataFrame) -> DataFrame:
    """Sections (``markdown.SCHEMA``) of what Python, Go and Rust files say about their modules, titled by these; lines count from where that begins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for package, file, how, text in zip(frame.package, frame.file, frame.how, frame.text, strict=True):
                try:
                    first, title, doc = module_doc(how, package or "", file or "", text)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for line, name, part, parents, imports in markdown.split(doc, title) if doc.strip() else ():
                    rows.append((package, file, line + first - 1, name, part, [p + first - 1 for p in parents], imports))
            yield pd.DataFrame(rows, columns=["package", "file", "line", "name", "doc", "parents", "imports"])

    how, text = F.col("how"), F.col("text")
    says = F.when(how == "rust", text.rlike(r"//!|/\*!")).when(how == "go", text.rlike(r"(//|\*/)[^\n]*\n\s*package\b")).when(how == "python", text.rlike("\"|'"))
    usable = files.filter(says & (F.octet_length("text") <= MAX_SOURCE))
    return spread(usable.select("package", "file", "how", "text"), compact=True).mapInPandas(run, markdown.SCHEMA)


def entries(found: DataFrame, versions: DataFrame, by_file: bool = False) -> DataFrame:
    """Symbols with ``legacy`` and ``entry_id``: of equal path, signature and length of doc in a package the first counts.

    ``versions``: ``package, version`` (and ``eco``, if known). With ``by_file`` equal declarations of different files
    all stay, as editions of an npm package are told apart by their files. Ids are of the place, the signature and the
    doc, so parts of one section differ.
    """
    keys = ["package", "path", "sig", F.length("doc").alias("n"), *([F.col("file").alias("at")] if by_file else [])]
    rest = [c for c in found.columns if c not in ("package", "path", "sig")]
    first = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("file", "line")).alias("e"))
    major = X.major_of(F.col("version"))
    flat = first.join(versions, "package").select("package", *[c for c in versions.columns if c != "package"], "e.*", "path", "sig", major.alias("major"))
    return flat.withColumn("legacy", X.legacy_file(F.col("file"), F.col("major"))).withColumn("entry_id", F.xxhash64(*[c for c in ("eco", "package", "version") if c in flat.columns], "file", "line", "path", "sig", "doc"))
