"""Items of source code: owners, and braces that are none, for each language of the table."""

import pytest

from vecloom.sources import chunks, code


def items(language, text):
    return [(r.kind, r.title, r.owner, r.start, r.stop) for r in code.code_items(text, language)]


def test_rust():
    text = """// fn no() {
/* /* fn no() { */ { */
impl<T: Fn(u8) -> Vec<T>> Show for a::Tree<T> {
    /// doc
    pub async fn walk<'a>(&'a self) -> char {
        let s = "} \\" {"; let r = r##"}"# {"##; let b = b"{";
        if true { '{' } else { '\\u{7d}' }
    }
    const fn empty() {}
}
pub(crate) struct S { a: u8 }
struct Unit;
enum E { A { x: u8 }, B }
trait T { fn asked(&self); fn given(&self) { } }
mod m { fn inner() { fn nested() {} } }
fn multi() {
    let s = "over
} lines {";
}"""
    assert items("rs", text) == [
        ("impl", "Tree", "", 3, 10), ("fn", "walk", "Tree", 5, 8), ("fn", "empty", "Tree", 9, 9), ("struct", "S", "", 11, 11), ("struct", "Unit", "", 12, 12), ("enum", "E", "", 13, 13),
        ("trait", "T", "", 14, 14), ("mod", "m", "", 15, 15), ("fn", "multi", "", 16, 19),
    ]
    assert items("rs", "trait T {\n    fn asked(&self);\n    fn given(&self) {}\n}") == [("trait", "T", "", 1, 4), ("fn", "asked", "T", 2, 2), ("fn", "given", "T", 3, 3)]


def test_scripts():
    text = """/* function no() { */ import x from "y{";
export default class A extends B {
  #n = '}'; static s = `a ${ {b: `}${1}`}.b } {`;
  constructor(x) { super(x); if (x) { y(); } }
  async *go<T>(a: {b: c}): Promise<void> { }
  get value(): string { return `}`; }
}
interface I { f(): void }
const arrow = async (a, b) => { return "{"; };
let one = x => x + 1;
function plain() {
  function inner() { }
}"""
    assert items("ts", text) == [
        ("class", "A", "", 2, 7), ("method", "constructor", "A", 4, 4), ("method", "go", "A", 5, 5), ("method", "value", "A", 6, 6), ("interface", "I", "", 8, 8),
        ("function", "arrow", "", 9, 9), ("function", "one", "", 10, 10), ("function", "plain", "", 11, 13), ("function", "inner", "plain", 12, 12),
    ]
    assert items("js", "class A {\n  m() {\n    for (;;) { }\n  }\n}\nclass B {}") == [("class", "A", "", 1, 5), ("method", "m", "A", 2, 4), ("class", "B", "", 6, 6)]


def test_go():
    text = """package p // {
type S struct {
	a string // }
}
type I interface { F() }
func (s *S) Run(a int) string {
	return `}{` + "}" + string('{')
}
func main() { }"""
    assert items("go", text) == [("struct", "S", "", 2, 4), ("interface", "I", "", 5, 5), ("method", "Run", "", 6, 8), ("function", "main", "", 9, 9)]


def test_java():
    text = '''/** class No { */
public final class A<T> extends B {
    private String s = "}";
    char c = '}';
    String t = """
        } " {
        """;
    public A(int x) { this.s = s; }
    @Override public <U> List<U> go(int a) throws E { if (a > 0) { return x(a); } return null; }
    abstract void none();
    enum Kind { ONE, TWO }
}
interface I { void f(); }'''
    assert items("java", text) == [
        ("class", "A", "", 2, 12), ("method", "A", "A", 8, 8), ("method", "go", "A", 9, 9), ("method", "none", "A", 10, 10), ("enum", "Kind", "A", 11, 11), ("interface", "I", "", 13, 13),
    ]


@pytest.mark.parametrize("language", ["c", "cpp"])
def test_c(language):
    text = """#define X '{'
struct point { int x; };
enum color { RED, GREEN };
static const char *name(int a, char b)
{
    const char *s = "}"; /* { */ // {
    if (a) { return s; }
    return R"x(} { )" )x";
}
int declared(int);
class Box {
    int size() const { return 1; }
};
void Box::grow(int by) { }"""
    assert items(language, text) == [("struct", "point", "", 2, 2), ("enum", "color", "", 3, 3), ("function", "name", "", 4, 9), ("class", "Box", "", 11, 13), ("method", "size", "Box", 12, 12), ("function", "grow", "", 14, 14)]


@pytest.mark.parametrize("language", sorted(code.LANGUAGES))
def test_broken_and_odd_sources(language):
    for text in ("", "\n", "{{{", "}}}", '"', "'", "/*", "`${", 'r#"', "fn f(", "class A {", "func f() {\n  `", "struct"):
        for r in code.code_items(text, language):
            assert 1 <= r.start <= r.stop <= text.count("\n") + 1
    long = "// {\n" * 20_000 + "class A {\n}\n"
    assert [x[3:] for x in items(language, long)] in ([(20_001, 20_002)], [])


def test_masks_keep_places():
    text = "let a = \"x{\";\n/* y\n} */ '}' z"
    out = code.masked(text, code.RUST)
    assert len(out) == len(text) and out.count("\n") == 2 and "{" not in out and "}" not in out and out.endswith("z")


def test_owners_in_the_table_function(spark):
    chunks.register(spark)
    got = spark.sql("SELECT kind, title, owner, doc FROM extract_items('java', 'class A {\n  // says\n  void f() { }\n}')").collect()
    assert [tuple(r) for r in got] == [("class", "A", "", ""), ("method", "f", "A", "says")]
    got = spark.sql("SELECT title, owner FROM extract_items('py', 'class A:\n  def f(self):\n    def g(): pass\n')").collect()
    assert sorted(map(tuple, got)) == [("A", ""), ("f", "A"), ("g", "f")]
