"""Declarations that span lines, nest, or stand beside text that looks like one; hostile input in linear time."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.plans.engine import Engine
from quillstack.sources import declarations, symbols


def short(rows):
    return {r[3]: (r[0], r[1], r[4], r[5]) for r in rows}


def test_go():
    text = """// Package web serves.
package web

// Ctx is one request.
type Ctx struct {
	Keys map[string]any // all keys
}

// JSON writes { obj }.
// As JSON.
func (c *Ctx) JSON(
	code int,
	obj interface{ Close() error },
) (err error) {
	fmt.Println("func Fake() {", `
func Raw() {}
`)
}
func (p pool[T]) Get() T { return p.x }
func (p *Pool[K, V]) Get(k K) (v V, ok bool) { return }
const (
	// A is first.
	A = iota // one
	B
	c, D = 3, 4
)
type (
	Handler interface {
		// Serve serves.
		Serve(c *Ctx) error
		fmt.Stringer
	}
	List[T any] []T
)
func Any() interface{} { return nil }
/*
Block doc.
*/
func Last(opts ...Option) *Engine
"""
    got = short(symbols.go(text))
    assert got == {
        "Ctx": (5, "struct", "type Ctx struct { Keys map[string]any }", "Ctx is one request."),
        "Ctx.JSON": (11, "method", "func (c *Ctx) JSON(code int, obj interface{ Close() error }) (err error)", "JSON writes { obj }.\nAs JSON."),
        "Pool.Get": (20, "method", "func (p *Pool[K, V]) Get(k K) (v V, ok bool)", ""), "A": (23, "const", "const A = iota", "A is first."), "B": (24, "const", "const B", ""), "D": (25, "const", "const c, D = 3, 4", ""),
        "Handler": (28, "interface", "type Handler interface { Serve(c *Ctx) error fmt.Stringer }", ""), "Handler.Serve": (30, "method", "Serve(c *Ctx) error", "Serve serves."), "List": (33, "struct", "type List[T any] []T", ""),
        "Any": (35, "function", "func Any() interface{}", ""), "Last": (39, "function", "func Last(opts ...Option) *Engine", "Block doc."),
    }
    assert declarations.go_module(text) == (1, "Package web serves.", "web") and declarations.go_module("// Command x.\npackage main\n")[1] == "" and not list(symbols.go("// X\npackage main\nfunc X() {}\n"))


def test_rust():
    text = """//! Crate docs.
cfg_rt! {
    /// Spawns a task.
    #[track_caller]
    pub fn spawn<F>(future: F) -> JoinHandle<F::Output>
    where
        F: Future + 'static,
    {
        let c = '{'; let s = "pub fn fake() {"; /* nested /* { */ { */
    }
}
pub(crate) struct Hidden;
impl<S: Into<Vec<u8>>, F: Fn(&S) -> u8> Router<S> where S: Clone {
    /// Add a route.
    pub const fn route(self, path: &str) -> Self { self }
    fn private(&self) {}
}
impl<'a> fmt::Debug for Router<'a> { pub fn nope() {} }
#[doc(hidden)]
pub fn hidden() {}
/// Deep.
pub mod deep {
    mod closed { pub fn unseen() {} }
    pub mod er { pub unsafe fn go(x: [u8; 4]) -> u8; pub static mut N: u8 = { 1 }; }
    pub trait Visit { fn visit(&self) -> Self::Out; }
}
macro_rules! doc { ($x:item) => {
    /// Waits.
    #[macro_export]
    $x }; }
doc! {macro_rules! select { () => {}; }}
pub extern "C" fn ffi(x: &'static str) -> *const u8 { r#"}"# }
"""
    got = short(symbols.rust(text))
    assert got == {
        "spawn": (5, "function", "pub fn spawn<F>(future: F) -> JoinHandle<F::Output> where F: Future + 'static,", "Spawns a task."), "Router::route": (15, "method", "pub const fn route(self, path: &str) -> Self", "Add a route."),
        "deep": (22, "module", "pub mod deep", "Deep."), "deep::er::go": (24, "function", "pub unsafe fn go(x: [u8; 4]) -> u8", ""), "deep::er::N": (24, "const", "pub static mut N: u8 = { 1 }", ""),
        "deep::Visit": (25, "trait", "pub trait Visit", ""), "deep::Visit::visit": (25, "method", "fn visit(&self) -> Self::Out", ""), "select!": (31, "macro", "macro_rules! select { () => {}; }", "Waits."),
        "ffi": (32, "function", "pub extern \"C\" fn ffi(x: &'static str) -> *const u8", ""),
    }
    assert declarations.rust_module(text) == (1, "Crate docs.")


def test_typescript():
    text = """/** Makes one. */
export declare function object<T extends Shape>(
  shape: T,
  params?: { a: string; b: number },
): { out: T; };
declare namespace z {
  namespace inner { const deep: (x: number) => Map<string, number>; }
}
export interface Type<T>
  extends Base<{ x: T }> {
  readonly _def: Def;
  readonly size: number
  new (x: number): Type<T>;
  (call: string): void
  [key: string]: any;
  "quoted-name"?: { a: string, b: number };
  on(cb: (e: { type: string }) => void): this, off(): void
  map: Map<string, number>;
}
export declare abstract class Box<T> extends Type<T> implements A, B {
  #hidden = 1;
  /** Opens. */
  @mark({ x: 1 })
  open(message?: string): Box<T>;
  private cached;
  static get shape(): T;
  handler = async (x) => { if (x) { return 1 } };
}
export const a = 1, f = (x: number): { y: 1 } => { return x }, g = function (q) { return "function fake() {" };
export { Box as obj, a as default,
  f as ff } from "./x";
export * as zz from "./external";
export type Shape = {
  [k: string]: Type<any>;
} & { extra: 1 }
declare module "other" { export function patched(): void }
export default class Main { run() { const re = /[{]/g; class NotMe {} } }
type Union =
  | "a"
  | "b"
let last: string
"""
    got = short(symbols.typescript(text, "index.d.ts"))
    assert {k: v[:3] for k, v in got.items()} == {
        "object": (2, "function", "function object<T extends Shape>(shape: T, params?: { a: string; b: number }): { out: T; }"), "z": (6, "module", "namespace z"), "z.inner": (7, "module", "namespace inner"),
        "z.inner.deep": (7, "function", "const deep: (x: number) => Map<string, number>"), "Type": (9, "interface", "interface Type<T> extends Base<{ x: T }>"), "Type.size": (12, "field", "readonly size: number"),
        "Type.quoted-name": (16, "field", '"quoted-name"?: { a: string, b: number }'), "Type.on": (17, "method", "on(cb: (e: { type: string }) => void): this"), "Type.off": (17, "method", "off(): void"), "Type.map": (18, "field", "map: Map<string, number>"),
        "Box": (20, "class", "abstract class Box<T> extends Type<T> implements A, B"), "Box.open": (24, "method", "open(message?: string): Box<T>"), "Box.shape": (26, "method", "static get shape(): T"),
        "Box.handler": (27, "field", "handler = async (x) => { if (x) { return 1 } }"), "a": (29, "const", "const a = 1"), "f": (29, "function", "const f = (x: number): { y: 1 }"), "g": (29, "function", "const g = function (q)"),
        "obj": (30, "re-export", 'export { Box as obj, a as default, f as ff } from "./x"'), "ff": (31, "re-export", 'export { Box as obj, a as default, f as ff } from "./x"'), "zz": (32, "module", 'export * as zz from "./external"'),
        "Shape": (33, "type", "type Shape = { [k: string]: Type<any>; } & { extra: 1 }"), "patched": (36, "function", "function patched(): void"), "Main": (37, "class", "class Main"), "Main.run": (37, "method", "run()"), "Union": (38, "type", 'type Union = | "a" | "b"'), "last": (41, "const", "let last: string"),
    }
    assert got["object"][3] == "Makes one." and got["Box.open"][3] == "Opens."
    js = "function hid() {}\n/** Said. */\nfunction said(a, b) { return `x${a}` }\nexport const k = 2\n"
    assert set(short(symbols.typescript(js, "a.js"))) == {"said", "k"} and set(short(symbols.typescript(js, "a.ts"))) == {"hid", "said", "k"}


@pytest.mark.parametrize("how", ["go", "rust", "ts"])
def test_hostile_texts_take_linear_time(how):
    start = time.time()
    for text in ("{" * 100000, "(" * 50000 + "}" * 50000, "`" * 50001, "'" * 50001, "/*" * 50000, "interface X {" + "a<b," * 30000 + "}", "const x\n" * 20000, "#[" * 30000, "@a(" * 30000, "=/" * 50000, 'r"' * 30001, "", "\0", "\n"):
        list(symbols.PARSERS[how](text))
    assert time.time() - start < 20


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="{}()[]<>=;,:'\"`/*#!@\n abfnpubexportclassfunctype", max_size=120), st.sampled_from(["go", "rust", "ts"]))
def test_any_text_gives_symbols_within_it(text, how):
    for row in symbols.PARSERS[how](text):
        assert 1 <= row[0] <= text.count("\n") + 1 and row[2]


def test_module_docs_are_searched(spark):
    rows = [("tiny-rt", "src/task/mod.rs", "rust", "//! Runs tasks.\n//!\n//! # Usage\n//! Call it.\npub fn f() {}\n"), ("tiny-rt", "a.py", "python", '"""Says a.\n"""\n'), ("tiny-rt", "broken.py", "python", '"""x"""\ndef ('), ("tiny-rt", "none.rs", "rust", None)]
    files = spark.createDataFrame(rows, "package string, file string, how string, text string")
    index = Engine.build_index(files, spark.createDataFrame([("tiny-rt", "1.0.0")], "package string, version string"))
    got = sorted((r.kind, r.name, r.line, r.doc) for r in index.collect())
    assert got == [("doc", "a", 1, "Says a."), ("doc", "tiny_rt::task", 1, "Runs tasks."), ("doc", "tiny_rt::task › Usage", 3, "Call it."), ("function", "f", 5, "")]
