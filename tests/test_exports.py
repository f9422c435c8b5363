"""Module graphs, entrypoints and what they export."""

import pytest
from pyspark.sql import functions as F

from quillstack.operators import exports
from quillstack.sources import modules, symbols

MANIFEST = """{"name": "@acme/forms", "exports": {".": {"types": "./index.d.cts", "default": "./index.cjs"}, "./fresh": {"types": "./fresh/index.d.ts"},
 "./split": {"import": {"types": "./a.d.mts"}, "require": {"types": "./b.d.cts"}}, "./round": "./round.d.ts", "./gone": "./gone.d.ts", "./parts/*": "./parts/*.d.ts", "./parts/closed": null, "./helper": "./helper.d.ts", "./extra": "./extra.d.ts"}}"""
FILES = {
    "index.d.cts": "import * as f from './old/index.cjs';\nexport * from './old/index.cjs';\nexport { f, f as default };\n",
    "old/index.d.cts": "export * from './types.cjs';\nexport { make as create } from './types.cjs';\n",
    "old/types.d.cts": "/** Makes a form. */\nexport declare function make(text?: string): Form;\nexport declare class Form {\n  check(text?: string): Form;\n}\n",
    "fresh/index.d.ts": "export * from './types.js';\n", "fresh/types.d.ts": "export declare function make(): NewForm;\nexport declare class Form {\n  check(): NewForm;\n}\nexport declare function mail(o?: Options): Mail;\n",
    "hidden.d.ts": "export declare function mail(): RegExp;\n", "a.d.mts": "export declare function make(v: string): string;\n", "b.d.cts": "export declare function make(v: number): number;\n",
    "round.d.ts": "export * from './round2.js';\nexport * from './old/types.cjs';\n", "round2.d.ts": "export * from './round.js';\n", "parts/one.d.ts": "export declare function make(one: boolean): boolean;\n", "parts/closed.d.ts": "export declare function make(no: never): never;\n",
    "extra.d.ts": "export declare function extra(): void;\n", "helper.d.ts": "export declare const assist: number, aid: Map<string, number>;\nexport default function run(): void;\nexport import x = y;\n",
}


@pytest.fixture(scope="module")
def package(spark):
    files = spark.createDataFrame([("@acme/forms", f, "ts", t) for f, t in FILES.items()], "package string, file string, how string, text string")
    graph = {k: v.persist() for k, v in modules.graph(files).items()}
    roots = modules.roots(spark.createDataFrame([("@acme/forms", MANIFEST)], "package string, manifest string"), files).persist()
    entries = symbols.entries(symbols.symbols(files), spark.createDataFrame([("@acme/forms", "1.0.0")], "package string, version string"), by_file=True).persist()
    return files, graph, roots, entries


def test_statements():
    text = "import d, { a as b, type c } from './x.js'\n// export const no = 1\nexport type { T } from '../y'\nexport const p: Map<string, number> = f(1, 2), q = 3\nexport abstract class K {\n  export: string\n}\nexport = K\nexport as namespace Lib\nexport enum E {}\n"
    rows = modules.parse("lib/m.d.ts", text)
    assert [r[:4] for r in rows if r[0] == "import"] == [("import", "b", "named", "a"), ("import", "c", "named", "c"), ("import", "d", "named", "default")]
    assert [(r[1], r[2], r[3]) for r in rows if r[0] == "export"] == [("T", "named", "T"), ("p", "local", "p"), ("q", "local", "q"), ("K", "local", "K"), ("default", "local", "K"), ("E", "local", "E")]
    assert rows[-1][4] == "K" and rows[-1][6] is False and modules.parse("m.js", "module.exports = 1")[-1][6] is True
    assert modules.candidates("lib/m.d.ts", "./x.js") == ("lib/x.js", ["lib/x.d.ts", "lib/x.js", "lib/x.js.d.ts", "lib/x.js/index.d.ts", "lib/x.js.ts", "lib/x.js/index.ts"])
    assert modules.candidates("m.d.ts", "../x")[0] == "" and modules.candidates("m.d.ts", "react")[0] == "external:react"


def test_entrypoints(package):
    _, _, roots, _ = package
    got = {(r["import"].removeprefix("@acme/forms"), r.conditions, r.file) for r in roots.collect()}
    assert got == {("", "/types", "index.d.cts"), ("/fresh", "/types", "fresh/index.d.ts"), ("/split", "/import/types", "a.d.mts"), ("/split", "/require/types", "b.d.cts"), ("/round", "", "round.d.ts"), ("/gone", "", "gone.d.ts"), ("/parts/one", "", "parts/one.d.ts"), ("/helper", "", "helper.d.ts"), ("/extra", "", "extra.d.ts")}


def test_packages_without_a_map_export_by_path(spark):
    files = spark.createDataFrame([("p", f) for f in ("main.d.ts", "lib/index.d.ts", "lib/x.js")], "package string, file string")
    got = {(r["import"], r.file, r.legacy) for r in modules.roots(spark.createDataFrame([("p", '{"types": "main.d.ts"}')], "package string, manifest string"), files).collect()}
    assert got == {("p", "main.d.ts", True), ("p/main", "main.d.ts", True), ("p/lib/index", "lib/index.d.ts", True), ("p/lib", "lib/index.d.ts", True), ("p/lib/x", "lib/x.js", True)}


def test_statuses(spark, package):
    _, graph, roots, entries = package
    asked = [("", "Form.check"), ("", "f.Form.check"), ("", "default.Form.check"), ("", "create"), ("", "mail"), ("", "Nothing"), ("/fresh", "Form.check"), ("/split", "make"), ("/gone", "make"), ("/round", "make"), ("/parts/one", "make"), ("/none", "make")]
    rows = spark.createDataFrame([("@acme/forms", "@acme/forms" + i, s) for i, s in asked], "package string, import string, symbol string")
    sig = {r.entry_id: (r.sig, r.file, r.line) for r in entries.collect()}
    got = {(r["import"].removeprefix("@acme/forms"), r.symbol): (r.status, [sig[e] for e in r.entry_ids], [a["offer"] for a in r.alternatives]) for r in exports.statuses(rows, roots, graph, entries).collect()}
    old = [("check(text?: string): Form", "old/types.d.cts", 4)]
    for name in ("Form.check", "f.Form.check", "default.Form.check"):
        assert got[("", name)][:2] == ("exact", old)
    assert got[("", "create")][0] == "exact" and got[("", "create")][1][0][1:] == ("old/types.d.cts", 2)
    assert got[("", "mail")] == ("not_exported", [], ["@acme/forms/fresh"]) and got[("", "Nothing")][0] == "not_exported"
    assert got[("/fresh", "Form.check")][1][0][0] == "check(): NewForm" and got[("/split", "make")][0] == "ambiguous"
    assert got[("/gone", "make")][0] == got[("/none", "make")][0] == "unresolved" and got[("/round", "make")][0] == "exact"
    assert got[("/parts/one", "make")][0] == "exact" and "@acme/forms/split" in got[("/parts/one", "make")][2]


def test_files_and_compatible_imports(package):
    _, graph, roots, _ = package
    seen = {}
    for r in exports.search_files(roots, graph).collect():
        seen.setdefault(r["import"].removeprefix("@acme/forms"), set()).add(r.file)
    assert seen[""] == {"index.d.cts", "old/index.d.cts", "old/types.d.cts"} and seen["/fresh"] == {"fresh/index.d.ts", "fresh/types.d.ts"}
    assert seen["/round"] == {"round.d.ts", "round2.d.ts", "old/types.d.cts"}
    pairs = {(r["import"].removeprefix("@acme/forms"), r.other.removeprefix("@acme/forms")) for r in exports.compatible_imports(roots, graph).collect()}
    assert {(i, i) for i in ("", "/fresh", "/split", "/round", "/parts/one", "/helper")} <= pairs
    assert ("", "/fresh") not in pairs and ("", "/parts/one") not in pairs and ("", "/extra") in pairs and ("", "/helper") not in pairs


def test_layers_and_cycles_end_quickly(spark):
    edges = [("p", f"l{i}{a}", f"l{i + 1}{b}") for i in range(22) for a in "xy" for b in "xy"] + [("p", f"c{i}", f"c{j}") for i in range(12) for j in range(12) if i != j] + [("p", f"s{i}", f"s{i + 1}") for i in range(40)]
    names = sorted({f for _, a, b in edges for f in (a, b)})
    graph = {
        "stars": spark.createDataFrame(edges, "package string, file string, target string"), "modules": spark.createDataFrame([("p", n, False, None) for n in names], "package string, file string, incomplete boolean, assignment string"),
        "exports": spark.createDataFrame([("p", n, f"v{n}", "local", None, n) for n in names], "package string, file string, name string, kind string, target_file string, target_name string"),
        "imports": spark.createDataFrame([], "package string, file string, name string, kind string, target_file string, target_name string"),
    }
    roots = spark.createDataFrame([("p", i, "", f) for i, f in (("p", "l0x"), ("p/c", "c0"), ("p/s", "s0"))], "package string, import string, conditions string, file string")
    near = exports.closure(roots.select("package", "import", "file"), graph["stars"])
    assert {r["import"]: (r.n, r.d) for r in near.groupBy("import").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()} == {"p": (45, 22), "p/c": (12, 1), "p/s": (41, 40)}
    known = {r["import"]: len(r.names) for r in exports.surface(roots, graph).collect()}
    assert known == {"p": 45, "p/s": 41}
    graph["exports"] = graph["exports"].filter("file = 's40'")
    ends = {r.file: r.canonical for r in exports.canonical(graph).collect()}
    assert ends["s0"] == "s40" and ends["l22x"] == "l22x" and ends["c0"] == "c0"
