"""Small tables that operators of the engine are shown on, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name: (columns as DDL, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "deps": ("eco string, name string, norm_name string, version string, direct boolean", [
        ("npm", "tiny-schema", "tiny-schema", "1.2.0", True), ("pypi", "tinymodel", "tinymodel", "2.0.1", True), ("cargo", "tinyrt", "tinyrt", "0.3.0", True),
        ("go", "example.com/tinyweb", "example.com/tinyweb", "v1.4.0", True), ("npm", "missing-pkg", "missing-pkg", "2.0.0", True), ("pypi", "Typing_Extensions", "typing-extensions", "4.9.0", False),
    ]),
    "sources": ("eco string, norm_name string, version string, priority int", [
        ("npm", "tiny-schema", "1.2.0", 2), ("npm", "tiny-schema", "1.1.0", 1), ("pypi", "tinymodel", "2.0.1", 1), ("cargo", "tinyrt", "0.2.9", 1), ("cargo", "tinyrt", "0.2.8", 1),
        ("go", "example.com/tinyweb", "v1.4.0", 3), ("pypi", "typing-extensions", "4.8.0", 1),
    ]),
    "old_entries": ("package string, entry_id long, kind string, name string, path string, file string, sig string, doc string, alias_of string, legacy boolean", [
        ("p", 1, "function", "parse", "parse", "a.ts", "function parse(x: string): Value", "Parses a text into a value.", None, False),
        ("p", 2, "function", "load", "load", "a.ts", "function load(path: string): Value", "Loads a value from a file on disk.", None, False),
        ("p", 3, "class", "Box", "Box", "b.ts", "class Box", "A box.", None, False),
        ("p", 4, "method", "open", "Box.open", "b.ts", "open(force?: boolean): void", "Opens the box.", None, False),
        ("p", 5, "method", "close", "Box.close", "b.ts", "close(): void", "Closes the box.", None, False),
        ("p", 6, "function", "gone", "gone", "c.ts", "function gone(): never", "Nothing like this remains.", None, False),
        ("p", 7, "function", "again", "again", "c.ts", "function again(): number", "Works as ever.", None, False),
        ("p", 8, "doc", "Guide", "Guide", "README.md", "", "How to open a Box.", None, False),
        ("p", 9, "function", "older", "older", "v1/c.ts", "function older(): number", "", None, True),
    ]),
    "new_entries": ("package string, entry_id long, kind string, name string, path string, file string, sig string, doc string, alias_of string, legacy boolean", [
        ("p", 21, "function", "parse", "parse", "a.ts", "function parse(x: string, strict?: boolean): Value", "Parses a text into a value.", None, False),
        ("p", 22, "function", "read", "read", "a.ts", "function read(path: string): Value", "Reads a value.", None, False),
        ("p", 23, "class", "Box", "Box", "b.ts", "class Box", "A box. @deprecated use `Crate` instead", None, False),
        ("p", 24, "method", "unlock", "Box.unlock", "b.ts", "unlock(): boolean", "Opens the box.", None, False),
        ("p", 25, "method", "close", "Box.close", "b.ts", "close():  void", "Closes the box.", None, False),
        ("p", 26, "re-export", "again", "again", "c.ts", "export { more as again }", "", "more", False),
        ("p", 27, "function", "more", "more", "c.ts", "function more(): number", "Works as ever.", None, False),
        ("p", 28, "doc", "Migrating", "Migrating", "MIGRATING.md", "", "Replace load by read; Box is going away.", None, False),
        ("p", 29, "class", "Crate", "Crate", "b.ts", "class Crate", "A crate.", None, False),
    ]),
    "sources_text": ("file string, text string", [
        ("app.ts", "import { load, Box } from 'p'\nconst v = load('x')\nloader(1)\nnew Box().open()\nopen('x')"), ("lib.ts", "import * as p from 'p'\np.load('y'); p.parse('z')\nbox.open(true)\nreload()"), ("none.ts", "load('q')"),
    ]),
    "roots": ("package string, import string, file string", [("f", "f", "index.ts"), ("f", "f/next", "next.ts"), ("f", "f/cycle", "cycle.ts"), ("f", "f/lost", "lost.ts")]),
    "stars": ("file string, target string", [("index.ts", "stable.ts"), ("stable.ts", "base.ts"), ("cycle.ts", "cycle2.ts"), ("cycle2.ts", "cycle.ts")]),
    "exports": ("file string, name string, target_file string, target_name string", [
        ("index.ts", "create", "build.ts", "build"), ("index.ts", "default", None, "Form"), ("stable.ts", "Form", None, "Form"), ("stable.ts", "default", None, "hidden"), ("base.ts", "Form", None, "BaseForm"),
        ("base.ts", "email", None, "email"), ("build.ts", "build", None, "build"), ("next.ts", "Form", None, "ModernForm"), ("next.ts", "validate", "check.ts", "run"), ("check.ts", "run", "run.ts", "go"), ("run.ts", "go", None, "go"),
        ("cycle.ts", "build", None, "build"), ("cycle2.ts", "other", None, "other"), ("lost.ts", "build", "nowhere.ts", "build"),
    ]),
    "asked_symbols": ("symbol string", [("Box.open",), ("parse()",), ("box",), ("p.load",), ("again",)]),
    "answers": ("id string, answer string, expect array<array<string>>, reject array<string>", [
        ("a", "Use model_dump() instead of dict()", [["model_dump"], ["dict", "mapping"]], ["parse_obj"]), ("b", "Call parse_obj", [["model_validate"]], []), ("c", "MODEL_VALIDATE works; parse_obj does not", [["model_validate"]], ["parse_obj"]), ("d", "anything", [], []),
    ]),
    "packages": ("name string, version string", [("zod", "3.23.8"), ("@scope/kit", "1.0.0"), ("tokio", "1.40.0"), ("gone", "9.9.9")]),
    "refs": ("ref string, oid string, peeled boolean", [("v3.23.8", "aa", False), ("v3.23.8", "ab", True), ("3.23.8", "ac", True), ("@scope/kit@1.0.0", "ba", False), ("kit-1.0.0", "bb", False), ("tokio-1.40.0", "ca", False), ("main", "zz", False)]),
    "archive_files": ("package string, path string, bytes long", [("p", "a.md", 40), ("p", "b.md", 70), ("p", "c.md", 30), ("p", "d.md", 30), ("q", "x.md", 200), ("q", "y.md", 90), ("q", "z.md", 20)]),
    "guides": ("question_id long, package string, entry_id long, name string, kind string, legacy boolean, text string, score double", [
        (1, "p", 1, "dict", "method", False, "Deprecated: use `model_dump` instead.", 1.0), (1, "p", 2, "model_dump", "method", False, "Dumps the model.", 0.4), (1, "p", 3, "json", "method", False, "Renamed to `model_dump_json`.", 0.3),
        (1, "p", 4, "model_dump_json", "method", False, "Dumps JSON.", 0.5), (1, "p", 5, "strictObject", "function", False, "Consider z.strictObject(A.shape). You can use this too.", 0.2), (1, "q", 6, "model_dump", "method", False, "Of another package.", 0.1), (1, "p", 7, "model_dump", "function", True, "Old.", 0.05),
    ]),
    "names": ("eco string, name string", [("pypi", "Typing_Extensions.foo"), ("cargo", "serde_json"), ("npm", "React-DOM"), ("go", "github.com/BurntSushi/toml"), ("pypi", "A--B__c")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


def sql(name: str) -> str:
    """The table as a SQL subquery."""
    ddl, rows = TABLES[name]
    columns = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]"}
    casts = [kinds[c.split()[1]] for c in ddl.split(", ")]

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    listed = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    picked = ", ".join(f"CAST({'c%d' % i} AS {k}) AS {'"%s"' % c}" for i, (c, k) in enumerate(zip(columns, casts, strict=True)))
    return f"(SELECT {picked} FROM (VALUES {listed}) v({', '.join(f'c{i}' for i in range(len(columns)))}))"
