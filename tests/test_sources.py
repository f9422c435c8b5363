"""Lockfiles, files, sections and symbols."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstack.sources import files, lockfiles, markdown, pages, projects, symbols

NPM = json.dumps({"packages": {"": {"dependencies": {"a": "^1"}}, "packages/w": {"devDependencies": {"@s/b": "1"}}, "node_modules/a": {"version": "1.2.0"}, "node_modules/@s/b": {"version": "2.0.0"}, "node_modules/a/node_modules/c": {"version": "3.0.0"},
                               "node_modules/l": {"link": True, "version": "1.0.0"}, "node_modules/alias": {"name": "real", "version": "4.0.0"}, "node_modules/g": {"version": "0.1.0", "resolved": "git+ssh://git@host/g.git#abc"}}})


@pytest.mark.parametrize(
    ("parser", "text", "manifest", "want"),
    [
        (lockfiles.npm, NPM, None, [("a", "1.2.0", True, "f"), ("@s/b", "2.0.0", True, "f"), ("real", "4.0.0", False, "f"), ("g", "0.1.0", False, "f (git)")]),
        (lockfiles.npm, '{"dependencies": {"a": {"version": "1.0.0"}}}', None, [("a", "1.0.0", True, "f")]),
        (lockfiles.pnpm, "importers:\n  .:\n    dependencies:\n      a:\n        version: 1.0.0(r@2)\n      l:\n        version: link:../l\npackages:\n  a@1.0.0: {}\n  '@s/b@2.1.0(x@1)': {}\n", None, [("a", "1.0.0", True, "f"), ("@s/b", "2.1.0", False, "f")]),
        (lockfiles.pnpm, "dependencies:\n  a: 1.0.0\npackages:\n  /a/1.0.0: {}\n  /@s/b/2.0.0: {}\n", None, [("a", "1.0.0", True, "f"), ("@s/b", "2.0.0", False, "f")]),
        (lockfiles.bun, '{"workspaces": {"": {"dependencies": {"a": "1",},},}, "packages": {"a": ["a@1.0.0", ",}"], "a/b": ["b@1.0.0"], "@s/c": ["@s/c@2.0.0"], "w": ["w@workspace:w"],},}', None, [("a", "1.0.0", True, "f"), ("@s/c", "2.0.0", False, "f")]),
        (lockfiles.yarn, '# yarn lockfile v1\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.1.0"\n  resolved "x"\n\nb@1:\n  version "1.0.0"\n', '{"dependencies": {"b": "1"}}', [("@s/a", "1.1.0", False, "f"), ("b", "1.0.0", True, "f")]),
        (lockfiles.yarn, '__metadata:\n  version: 6\n\n"a@npm:^1.0.0":\n  version: 1.2.3\n', '{"dependencies": {"a": "^1"}}', [("a", "1.2.3", True, "f")]),
        (lockfiles.cargo, '[[package]]\nname = "me"\nversion = "0.1.0"\ndependencies = ["serde 1.0.0"]\n[[package]]\nname = "serde"\nversion = "1.0.0"\nsource = "registry+https://x"\n[[package]]\nname = "g"\nversion = "0.2.0"\nsource = "git+https://x"\n', None, [("serde", "1.0.0", True, "f"), ("g", "0.2.0", False, "f (git)")]),
        (lockfiles.uv, '[[package]]\nname = "me"\nversion = "0"\nsource = { editable = "." }\ndependencies = [{ name = "A_b" }]\n[package.optional-dependencies]\nx = [{ name = "c" }]\n[[package]]\nname = "a-b"\nversion = "1"\n[[package]]\nname = "c"\nversion = "2"\nsource = { git = "u" }\n[[package]]\nname = "d"\nversion = "3"\n', None, [("a-b", "1", True, "f"), ("c", "2", True, "f (git)"), ("d", "3", False, "f")]),
        (lockfiles.poetry, '[[package]]\nname = "A"\nversion = "1"\n[[package]]\nname = "b"\nversion = "2"\n', '[tool.poetry.dependencies]\npython = "^3"\na = "1"\n', [("A", "1", True, "f"), ("b", "2", False, "f")]),
        (lockfiles.poetry, '[[package]]\nname = "b"\nversion = "2"\n', None, [("b", "2", True, "f")]),
        (lockfiles.pipfile, '{"default": {"a": {"version": "==1.0"}}, "develop": {"b": {"git": "u", "version": "==2"}}}', None, [("a", "1.0", True, "f"), ("b", "2", True, "f (git)")]),
    ],
)
def test_lockfile_parsers(parser, text, manifest, want):
    assert [r[1:] for r in parser(text, "f", manifest)] == want


def test_requirements_and_go_mod(spark):
    req = "# c\na==1.0\nb[x]==2.0 ; python_version > '3' # why\n-r other.txt\nc>=1\nd == 3.1,!=3.2\n"
    got = lockfiles.requirements(spark.createDataFrame([("p/requirements.txt", req)], "file string, text string")).orderBy("line").collect()
    assert [(r.name, r.version, r.direct) for r in got] == [("a", "1.0", True), ("b", "2.0", True), ("d", "3.1", True)]
    mod = "module m\n\ngo 1.22\n\nrequire (\n\tx.com/a v1.0.0\n\tx.com/b v1.1.0 // indirect\n)\nrequire x.com/c v2.0.0\nreplace x.com/a => x.com/a v1.0.9\nreplace (\n\tx.com/b => ../b\n)\n"
    got = lockfiles.go_mod(spark.createDataFrame([("go.mod", mod)], "file string, text string")).orderBy("line").collect()
    assert [(r.name, r.version, r.direct) for r in got] == [("x.com/a", "v1.0.9", True), ("x.com/b", "v1.1.0", False), ("x.com/c", "v2.0.0", True)]


def test_npm_by_variant_equals_the_parser(spark):
    got = lockfiles.npm_packages(spark.createDataFrame([("l", NPM), ("bad", "{")], "file string, text string")).collect()
    assert sorted((r.name, r.version, r.direct) for r in got) == sorted(r[1:4] for r in lockfiles.npm(NPM, "f", None))


def test_dependencies_of_projects(spark):
    rows = [("p", 0, "p/package-lock.json", "{broken", None), ("p", 0, "p/yarn.lock", 'a@1:\n  version "1.0.0"\n', '{"dependencies": {"a": "1"}}'), ("p", 0, "p/requirements.txt", "x==1\nX==1\n", None), ("p", 0, "p/requirements-dev.txt", "y==2\n", None), ("p", 1, "go.mod", "require x.com/a v1.0.0\n", None),
            ("r", 0, "r/uv.lock", "", None), ("r", 0, "r/poetry.lock", '[[package]]\nname = "b"\nversion = "2"\n', None), ("q", 0, "q/uv.lock", '[[package]]\nname = "z"\nversion = "1"\n', None), ("q", 0, "q/requirements.txt", "x==1\n", None)]
    got = lockfiles.dependencies(spark.createDataFrame(rows, "project string, depth int, file string, text string, manifest string")).collect()
    assert sorted((r.project, r.eco, r.norm_name, r.version, r.direct) for r in got) == [("p", "go", "x.com/a", "v1.0.0", True), ("p", "npm", "a", "1.0.0", True), ("p", "pypi", "x", "1", True), ("p", "pypi", "y", "2", True), ("q", "pypi", "z", "1", False)]


def test_sections():
    text = "intro\n\n# One\nbody one\n```ts\n# not a heading\nimport { a } from '@s/kit/sub'\n```\n## Two `code` {#id}\nbody two\n\nThree\n=====\nbody three\n<h2>Four</h2>\nbody four\n"
    got = markdown.split(text, "T")
    assert [(s[0], s[1]) for s in got] == [(1, "T"), (3, "T › One"), (9, "T › One › Two code"), (12, "T › Three"), (15, "T › Three › Four")]
    assert got[2][3] == [1, 3] and got[2][4] == ["@s/kit/sub"] and got[3][4] == []
    rst = "Top\n===\nx\n\nSub\n---\ny\n\nOther\n===\nz\n"
    assert [s[1] for s in markdown.split(rst, "T", markdown=False)] == ["T › Top", "T › Top › Sub", "T › Other"]
    long = "# Head\n" + "\n\n".join(["x" * 500] * 12)
    parts = markdown.split(long, "T")
    assert len(parts) > 2 and all(len(p[2]) <= markdown.HARD for p in parts) and "".join(p[2] for p in parts).count("x") == 6000
    lines = long.split("\n")
    assert parts[0][0] == 1 and all(lines[p[0] - 1] == p[2].split("\n")[0] for p in parts[1:]) and len({p[0] for p in parts}) == len(parts)
    plain, title = markdown.clean_mdx("---\ntitle: My page\ndescription: about\n---\nimport X from 'x'\n<Card>\ntext\n")
    assert title == "My page" and plain.split("\n") == ["about", "", "", "", "", "", "text", ""]


def test_symbols(spark):
    py = 'class A(Base):\n    """Doc of A."""\n    @property\n    def size(self) -> int:\n        """How big."""\n    def _hidden(self): ...\n    def __init__(self, x=1): ...\nasync def run(): ...\ndef _no(): ...\n'
    assert [(s[1], s[3], s[4], s[5]) for s in symbols.python(py)] == [("class", "A", "class A(Base)", "Doc of A."), ("method", "A.size", "@property def size(self) -> int", "How big."), ("method", "A.__init__", "def __init__(self, x=1)", ""), ("function", "run", "async def run()", "")]
    go = "package web\n\n// JSON writes obj as JSON.\nfunc (c *Context) JSON(code int, obj any) {\n}\n\ntype Router interface {\n}\nfunc private() {}\nconst Max = 3\n"
    assert [(s[0], s[1], s[3], s[5]) for s in symbols.go(go)] == [(4, "method", "Context.JSON", "JSON writes obj as JSON."), (7, "interface", "Router", ""), (10, "const", "Max", "")]
    assert not list(symbols.go("package main\nfunc X() {}"))
    rust = "/// Spawns a future.\npub fn spawn<F>(f: F) -> Handle {\n}\npub struct Runtime {}\nimpl Runtime {\n    /// Blocks.\n    pub fn block_on(&self) {}\n}\n#[doc(hidden)]\npub fn secret() {}\n#[macro_export]\nmacro_rules! select {\n}\n"
    assert [(s[1], s[3], s[5]) for s in symbols.rust(rust)] == [("function", "spawn", "Spawns a future."), ("struct", "Runtime", ""), ("method", "Runtime::block_on", "Blocks."), ("macro", "select!", "")]
    ts = "/** Creates an object schema. */\nexport declare function object<T>(shape: T): ObjectSchema<T>;\nexport interface ObjectSchema<T> {\n  strict(): ObjectSchema<T>;\n  _secret: number;\n  size: number;\n}\nexport { object as create };\n"
    assert [(s[1], s[3], s[6]) for s in symbols.typescript(ts)] == [("function", "object", None), ("interface", "ObjectSchema", None), ("method", "ObjectSchema.strict", None), ("field", "ObjectSchema.size", None), ("re-export", "create", "object")]
    rows = [("p", "a.py", "python", py), ("p", "b.py", "python", py), ("p", "broken.py", "python", "def ("), ("p", "v1/c.py", "python", "def old(): ...")]
    found = symbols.entries(symbols.symbols(spark.createDataFrame(rows, "package string, file string, how string, text string")), spark.createDataFrame([("p", "2.0.0")], "package string, version string"))
    got = found.collect()
    assert sorted((r.file, r.path, r.legacy) for r in got) == [("a.py", "A", False), ("a.py", "A.__init__", False), ("a.py", "A.size", False), ("a.py", "run", False), ("v1/c.py", "old", True)]


def test_plan_and_archives(spark):
    names = ["README.md", "src/a.py", "src/a.pyi", "src/only.pyi", "node_modules/x/README.md", ".git/README.md", "docs/guide.mdx", "strict-mode.md", "deep/other.md", "lib/b.d.ts", "lib/b.d.mts", "dist/index.d.ts", "dist/run.js", "tests/t.py", "notes.txt", "NEWS", "pkg/main_test.go", "pkg/main.go", "x.dist-info/METADATA", "internal/i.d.ts", "upstream:docs/a.txt", "upstream:examples/e.py", "upstream:app/page.tsx"]
    rows = spark.createDataFrame([("p", n) for n in names], "package string, file string")
    got = {r.file: r.how for r in files.plan(rows, pages=rows.filter("file = 'upstream:app/page.tsx'")).collect()}
    assert got == {
        "README.md": "prose", "src/a.py": "python", "src/only.pyi": "python", "docs/guide.mdx": "prose", "strict-mode.md": "prose", "lib/b.d.ts": "ts", "dist/index.d.ts": "ts", "NEWS": "prose", "pkg/main.go": "go", "x.dist-info/METADATA": "metadata",
        "upstream:docs/a.txt": "prose", "upstream:examples/e.py": "example", "upstream:app/page.tsx": "page",
    }
    assert {r.file for r in files.plan(rows.withColumn("eco", F.lit("npm")), public_api=True).collect()} >= {"lib/b.d.mts", "internal/i.d.ts"}
    assert {r.file for r in files.plan(rows.withColumn("eco", F.lit("pypi")).filter("file not like '%.d.%'")).collect()}.isdisjoint({"pkg/main.go", "dist/run.js"})
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ok/a.md", "hello")
        f.writestr("../out.md", "bad")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        for name in ("b.md", "/abs.md"):
            info = tarfile.TarInfo(name)
            info.size = 2
            f.addfile(info, io.BytesIO(b"hi"))
    df = spark.createDataFrame([("z", bytearray(z.getvalue())), ("t", bytearray(t.getvalue())), ("n", bytearray(b"nothing"))], "file string, content binary")
    assert sorted((r.archive, r.file, r.text) for r in files.unpack(df).collect()) == [("t", "b.md", "hi"), ("z", "ok/a.md", "hello")]


def test_native_expressions_stay_in_the_jvm(spark):
    df = lockfiles.requirements(spark.createDataFrame([("r.txt", "a==1")], "file string, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", "")
    assert df.filter(F.col("name") == "a").count() == 1


def test_what_is_installed_stands_for_a_lockfile(spark):
    listed = [
        ("/w/a/app/package.json", '{"dependencies": {"x": "1", "y": "2"}, "devDependencies": {"z": "1"}}'), ("/w/a/app/node_modules/x/package.json", '{"version": "1.0.0"}'), ("/w/a/node_modules/x/package.json", '{"version": "0.9.0"}'), ("/w/a/node_modules/@s/n/package.json", '{"version": "3.0.0"}'),
        ("/w/a/node_modules/z/package.json", '{"version": "1.5.0"}'), ("/w/a/app/pyproject.toml", '[project]\ndependencies = ["Some_thing>=1"]\n'), ("/w/a/app/.venv/pyvenv.cfg", ""), ("/w/a/app/.venv/lib/python3.12/site-packages/some_thing-1.2.dist-info/METADATA", "Name: x"),
        ("/w/a/app/.venv/lib/python3.12/site-packages/some_thing-1.2.dist-info/RECORD", 'some/a.py,sha,1\n../bin/x,,\nsome_thing-1.2.dist-info/RECORD,,\nsome/__pycache__/a.pyc,,\n'), ("/w/a/app/.venv/lib/python3.12/site-packages/other-2.0.dist-info/METADATA", ""), ("/w/a/package-lock.json", '{"packages": {"node_modules/never": {"version": "1"}}}'), ("/w/a/app/.git/HEAD", ""),
    ]
    table = spark.createDataFrame(listed, "path string, text string")
    roots = spark.createDataFrame([("a", "/w/a/app")], "project string, root string")
    got = {(r.eco, r.name, r.version, r.direct, r.origin) for r in projects.load(roots, table).collect()}
    assert got == {("npm", "x", "1.0.0", True, "node_modules"), ("npm", "z", "1.5.0", True, "node_modules"), ("pypi", "some-thing", "1.2", True, "site-packages"), ("pypi", "other", "2.0", False, "site-packages")}
    assert [r.file for r in projects.recorded(table).collect()] == ["some/a.py"]


def test_pages_and_routes():
    text = 'import X from "y";\nexport const metadata = { title: "Set up", description: "How to." };\nconst steps = [\n  { title: "Get it", body: <p>Run <code>add</code> now.</p>, code: { lang: "sh", code: "npm i" } },\n];\nexport default () => <div>\n<h2 id="m">More</h2>\n<p>After.</p>\n</div>;\n'
    body, title = pages.page_markdown(text)
    assert title == "Set up" and [line for line in body.split("\n") if line] == ["How to.", "## Get it", "Run `add` now.", "```sh", "npm i", "```", "## More", "After."]
    assert pages.route("upstream:app/(docs)/install/page.tsx") == "app/install" or pages.route("upstream:app/(docs)/install/page.tsx").endswith("install")
    assert pages.page_markdown("x" * 300_000) == ("", None)
