import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tessera.operators import chunking as C


def window(spark, content, size, overlap):
    df = spark.createDataFrame([("f.x", content)], "path string, content string")
    return [tuple(r) for r in C.sliding_window(df, size, overlap).select("byte_offset", "line_number", "token_count", "text").orderBy("ordinal").collect()]


def test_golden_windows(spark):
    assert window(spark, "", 10, 0.2) == [] == window(spark, " \n", 10, 0.2) == window(spark, None, 10, 0.2)
    assert window(spark, "hello world foo bar", 100, 0.2) == [(0, 1, 4, "hello world foo bar")]
    got = window(spark, "a b c d e f g h i j", 4, 0.5)
    assert [r[0] for r in got] == [0, 4, 8, 12, 16] and [r[2] for r in got] == [4, 4, 4, 4, 2]
    got = window(spark, "line1 word1 word2\nline2 word3 word4\nline3 word5 word6", 3, 0)
    assert [r[:2] for r in got] == [(0, 1), (18, 2), (36, 3)]
    with pytest.raises(ValueError):
        C.window_shape(0, 0.2)


def _model(content, size, overlap):
    toks = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\f\r]+", content.encode())]
    stride = max(size - int(size * min(max(overlap, 0), 0.9)), 1)
    data = content.encode()
    return [(toks[s][0], data[: toks[s][0]].count(b"\n") + 1, min(size, len(toks) - s), data[toks[s][0] : toks[min(s + size, len(toks)) - 1][1]].decode()) for s in range(0, len(toks), stride)]


@settings(max_examples=12, deadline=None)
@given(st.text(alphabet="aé \n\t\r\x0b\u00a0", max_size=120), st.integers(1, 9), st.sampled_from([0.0, 0.2, 0.5, 0.8, 0.95]))
def test_windows_match_a_byte_model(spark, content, size, overlap):
    assert window(spark, content, size, overlap) == _model(content, size, overlap)


def test_long_text(spark):
    got = window(spark, "word " * 60000, 512, 0.2)
    assert len(got) == 147 and got[1][0] == 410 * 5 and got[-1][2] == 60000 - 146 * 410


def test_prose():
    text = "# Title\n\nFirst paragraph with some words here.\n\n## Section\n\nSecond paragraph with more content here.\n"
    assert [(o, ln, n) for o, ln, _, n in C.prose_rows(text, 3, 500)] == [(0, 1, 8), (48, 5, 8)]
    assert C.prose_rows("", 3, 500) == []
    assert [t for *_, t, _ in C.prose_rows("one two three four five six\n\nx y", 5, 500)] == ["one two three four five six\nx y"]
    long = " ".join(["w"] * 600)
    assert [n for *_, n in C.prose_rows(long + "\n" + long, 5, 512)] == [600, 600]
    again = "same line here and more\n\nother words go in here now\n\nsame line here and more"
    assert [r[0] for r in C.prose_rows(again)] == [0, 25, 0] and [r[0] for r in C.prose_rows(again, exact_offsets=True)] == [0, 25, 53]


RUST = 'fn hello() {\n    println!("hello");\n}\n\nfn world() {\n    println!("world {}", 1);\n}\n\nstruct Foo {\n    a: i32,\n}\n'
PYTHON = 'import os\n\ndef greet(name):\n    return "hi " + name\n\nclass Calculator:\n    def add(self, a, b):\n        return a + b\n\n    def sub(self, a, b):\n        return a - b\n'


def test_code():
    rust = C.code_rows("test.rs", RUST, 3, 1000)
    assert [t.split("\n")[0] for _, _, t, _ in rust] == ["[test.rs] fn hello() {", "[test.rs] fn world() {", "[test.rs] struct Foo {"]
    python = C.code_rows("a.py", PYTHON, 3, 1000)
    assert [(o, ln) for o, ln, *_ in python] == [(11, 3), (53, 6)] and python[1][2].endswith("return a - b")
    assert C.code_rows("readme.txt", "x y z", 3, 1000) == []
    assert C.code_rows("a.go", "package x\n", 3, 1000) == [(0, 1, "package x\n", 2)]
    go = C.code_rows("a.go", "package x\n\nfunc (p *T) Run(a int) error {\n\treturn nil\n}\n\ntype T struct {\n\tA int\n}\n", 3, 1000)
    assert [t.split()[1] for _, _, t, _ in go] == ["func", "type"]
    ts = C.code_rows("a.ts", "import a from 'b';\nexport class A {\n  run() { return 1; }\n}\nconst f = (x) => {\n  return x + 1;\n};\n", 3, 1000)
    assert [t.split()[1] for _, _, t, _ in ts] == ["export", "(x)"]
    java = C.code_rows("A.java", "package a;\nimport b;\npublic final class A {\n  int x() { return 1; }\n}\n", 3, 1000)
    assert [t.split()[1] for _, _, t, _ in java] == ["public"] and java[0][1] == 3
    cpp = C.code_rows("a.cpp", "#include <x>\nint add(int a, int b) {\n  return a + b;\n}\nclass B : public A {\n  int x;\n};\n", 3, 1000)
    assert [t.split()[1] for _, _, t, _ in cpp] == ["int", "class"]


def test_large_definition_goes_by_blocks():
    body = "def f():\n" + "\n\n".join("    a = b + c + d + e\n    g = h + 1" for _ in range(5)) + "\n\n    x\n"
    got = C.code_rows("a.py", body, 5, 20)
    assert len(got) == 5 and {r[0] for r in got} == {0} and [r[1] for r in got][:2] == [1, 5]


def test_dispatch_keeps_columns(spark):
    df = spark.createDataFrame([("a.py", PYTHON, 1), ("b.md", "some words that make a paragraph", 2), ("c.zzz", "x y", 3), ("d.md", None, 4), ("e.py", "", 5)], "path string, content string, tag int")
    got = C.chunk_files(df)
    assert rows(got, "path", "tag", "ordinal") == [("a.py", 1, 0), ("a.py", 1, 1), ("b.md", 2, 0), ("c.zzz", 3, 0)]
    assert C.chunk_files(df.where("false")).collect() == []


#: Sources and the definitions that the grammars give for them, derived by hand from the node kinds.
GRAMMARS = {
    "javascript": (
        "const a = 1;\napp.get('/', (req, res) => { res.send(1); });\nfunction* g() { yield x => x + 1; }\nmodule.exports = { foo(a) { return a; }, bar: function() {}, async baz() { if (x) { y(); } } };\n"
        "const C = class { m() { return 1; } };\nexport default class D { n() {} }\nasync function q() {}\nlet z = async x => await x\nitems.map(i => i * 2, 3);\nconst s = t.replace(/[{\"']/g, '');\nclass E { }\n",
        ["(req, res) => { res.send(1); }", "x => x + 1", "foo(a) { return a; }", "async baz() { if (x) { y(); } }", "m() { return 1; }", "export default class D { n() {} }", "async function q() {}", "async x => await x", "i => i * 2", "class E { }"],
    ),
    "typescript": (
        "declare class A { m(): void; }\nabstract class B { abstract x(): void; run(a: number): string { return ''; } }\nexport abstract class E {}\ntype F = (a: string) => void;\nconst f: (a: number) => void = (a) => { g(a); };\n"
        "interface I { a: string }\nconst enum K { A, B }\nnamespace N { function inner(): void { } }\ndeclare function d(): void;\nconst r = (a: string): Promise<void> => { go(); };\n",
        ["class A { m(): void; }", "run(a: number): string { return ''; }", "export abstract class E {}", "(a) => { g(a); }", "interface I { a: string }", "const enum K { A, B }", "function inner(): void { }", "(a: string): Promise<void> => { go(); }"],
    ),
    "cpp": (
        "template <typename T, class U = std::vector<int>> class Box { T x; };\ntemplate<class T> T add(T a, T b) { return a + b; }\nnamespace a { int x; }\nextern \"C\" { int f(int a) { return a; } }\n"
        "static struct P { int a; } p;\nusing X = int;\nint main() { return 0; }\n",
        ["class Box { T x; }", "T add(T a, T b) { return a + b; }", "namespace a { int x; }", "int f(int a) { return a; }", "struct P { int a; }", "int main() { return 0; }"],
    ),
    "c": (
        "typedef struct { int a; } T;\ntypedef struct node { struct node *n; } Node;\nstatic inline int f(int a) { return a; }\nstruct x y = {1};\nint (*fp)(int);\n#define A(x) 1\nint main(void)\n{\n return 0;\n}\n",
        ["struct { int a; }", "struct node { struct node *n; }", "static inline int f(int a) { return a; }", "int main(void)\n{\n return 0;\n}"],
    ),
    "java": ("package a;\n@interface An { String v(); }\n@Deprecated\npublic final class A { void m() {} }\nrecord P(int a) { }\ninterface I {}\n", ["@Deprecated\npublic final class A { void m() {} }", "record P(int a) { }", "interface I {}"]),
    "rust": (
        "#[derive(A)]\npub struct S;\nunion U { a: u8 }\nimpl<T> X for Y<T> { fn a(&self) {} }\nmacro_rules! m { () => {} }\nextern \"C\" { fn q(); }\nconst fn z() -> u8 { b'{' }\n",
        ["pub struct S;", "impl<T> X for Y<T> { fn a(&self) {} }", "macro_rules! m { () => {} }", "const fn z() -> u8 { b'{' }"],
    ),
    "go": ("package x\n\ntype (\n\tA int\n\tB struct{ c int }\n)\n\nvar v = 1\n\nfunc (t *T) M() error {\n\treturn nil\n}\n", ["type (\n\tA int\n\tB struct{ c int }\n)", "func (t *T) M() error {\n\treturn nil\n}"]),
    "csharp": ("using A;\nnamespace N;\n[Serializable]\npublic sealed class C { void M() {} }\ninternal record R(int A);\n", ["namespace N;", "[Serializable]\npublic sealed class C { void M() {} }", "internal record R(int A);"]),
    "python": ("import os\n@wraps(f)\nasync def a():\n    pass\nif x:\n    class B:\n        def m(self):\n            pass\n", ["async def a():\n    pass", "class B:\n        def m(self):\n            pass"]),
}


@pytest.mark.parametrize("lang", GRAMMARS)
def test_definitions(lang):
    source, want = GRAMMARS[lang]
    assert [source[a:b] for a, b in C._definitions(source, lang)] == want


def test_blocks_keep_line_ends_and_blank_lines_before():
    body = "export class A {\n  a = b + c + d;\n\n\n  e = f + g + h;\n}\n"
    got = C.code_rows("a.js", body, 3, 6)
    assert [(r[0], r[1], r[2]) for r in got] == [(7, 1, "[a.js] class A {\n  a = b + c + d;\n"), (7, 4, "[a.js] \n  e = f + g + h;\n}\n")]
