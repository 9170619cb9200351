"""Definitions per language and the fallback to blocks."""

from srcatlas.operators.definitions import definitions, semantic_chunks


def found(files, path, text):
    rows = definitions(files({path: text})).collect()
    lines = text.split("\n")
    for r in rows:
        assert r.content == "\n".join(lines[r.start_line - 1 : r.end_line])
        assert r.filename == path.rsplit("/", 1)[-1]
    return sorted((r.start_line, r.end_line, r.function or "", r["class"] or "") for r in rows)


PYTHON = '''import os

@decorated
class A(Base):
    """Text."""

    def one(self):
        return 1

# a comment at the left
    async def two(
        self,
    ):
        def inner():
            pass
        return inner

def last(): pass
'''


def test_python(files):
    assert found(files, "d/a.py", PYTHON) == [
        (4, 16, "", "A"), (7, 8, "one", ""), (11, 16, "two", ""), (14, 15, "inner", ""), (18, 18, "last", ""),
    ]


GO = '''package x

import "fmt"

type Shape interface { Area() float64 }

type Point[T any] struct {
	X, Y T
	inner struct {
		a int
	}
}

type (
	Pair struct {
		a, b int
	}
	Name string
)

func (p *Point) Move(f func(int) int) {
	if true {
		fmt.Println("} not a brace") // nor this }
	}
}

func main() { run() }
func external(x int) int
func after() {
}
'''


def test_go(files):
    assert found(files, "a.go", GO) == [
        (7, 12, "", "Point"), (15, 17, "", "Pair"), (21, 25, "Move", ""), (27, 27, "main", ""),
        (28, 28, "external", ""), (29, 30, "after", ""),
    ]


JS = '''import { a } from "./a"
export default class Box extends Base {
  constructor(x) {
    this.x = x
  }
  async load() {
    if (a) {
      return list.map(v => v + 1)
    }
  }
}
export async function start() {
  go()
}
const add = (a, b) => {
  return a + b
}
const one = x => x + 1
var old = function (y) {
  return y
}
function* gen() {
}
'''


def test_javascript(files):
    got = found(files, "a.ts", JS)
    assert got == [
        (2, 11, "", "Box"), (3, 5, "constructor", ""), (6, 10, "load", ""), (8, 8, "", ""), (12, 14, "start", ""),
        (15, 17, "", ""), (15, 17, "add", ""), (18, 18, "", ""), (18, 18, "one", ""), (19, 21, "", ""), (19, 21, "old", ""),
    ]
    assert found(files, "a.JSX", JS) == got


def test_no_definitions(files):
    assert found(files, "a.py", "import os\nfrom a import b\n\nx = 1\n") == []
    assert found(files, "a.rb", "def f\nend\n") == []
    rows = semantic_chunks(files({"a.py": "import os\n\nx = 1\n", "b.py": "def f(): pass\n\nx = 1\n", "c.rb": "class A\n"})).collect()
    assert sorted((r.file, r.start_line, r.function) for r in rows) == [
        ("a.py", 1, None), ("a.py", 3, None), ("b.py", 1, "f"), ("c.rb", 1, None),
    ]


def test_header_without_end(files):
    assert found(files, "a.go", "func f() {\n  x") == [(1, 2, "f", "")]
    assert found(files, "a.py", "class A:\n  def f(self):") == [(1, 2, "", "A"), (2, 2, "f", "")]


def test_javascript_headers_over_several_lines(files):
    text = """class A {
  foo(
    a,
    b
  ) {
    return a
  }
  bar(x = g(), { y } = {}) {
    return /[{"]/.test(x) ? `{
      ${x}` : '{'
  }
}
/* function no() {
} */
const f = (
  a,
  b
) => {
  return b
}
const g = (x: number): number => x + 1
foo(function () {
  go()
})
export const h = async (q) => (
  q
)
function typed(a: { b: number }): { c: string } {
  return a
}
"""
    assert found(files, "a.ts", text) == [
        (1, 12, "", "A"), (2, 7, "foo", ""), (8, 11, "bar", ""), (15, 20, "", ""), (15, 20, "f", ""), (21, 21, "", ""), (21, 21, "g", ""),
        (22, 24, "", ""), (25, 27, "", ""), (25, 27, "h", ""), (28, 30, "typed", ""),
    ]


def test_python_texts_over_several_lines(files):
    text = '''def f(a="(",
      b=[
1]):
    """Text
at the left
def not_one(): pass
"""
    return "\\
x"

class B:
    x = (
1,
    )
    def g(self): return {
    }
'''
    assert found(files, "a.py", text) == [(1, 9, "f", ""), (11, 16, "", "B"), (15, 16, "g", "")]


def test_go_raw_strings_and_types_with_braces(files):
    text = """package x
func a() interface{} {
	s := `{{ {
	`
	return '{'
}
func b(m map[string]struct{}) map[string]struct{} {
	/* } */
	return m
}
func (t *T[K]) c(
	f func(x int) error,
) error {
	return nil
}
type E struct{}
"""
    assert found(files, "a.go", text) == [(2, 6, "a", ""), (7, 10, "b", ""), (11, 15, "c", ""), (16, 16, "", "E")]


def test_time_is_linear():
    import time

    from srcatlas.functions.source_spans import definition_spans

    def seconds(n):
        py = "".join(f"def f{i}(a,\n  b):\n    return {{1: [2]}}\n\n" for i in range(n))
        go = "".join(f"func f{i}(a int) {{\n\tif a {{ }}\n}}\n" for i in range(n))
        js = "".join(f"const f{i} = (a) => {{\n  return x.map(v => v)\n}}\n" for i in range(n))
        start = time.perf_counter()
        assert [len(definition_spans(e, t)) for e, t in ((".py", py), (".go", go), (".js", js))] == [n, n, 3 * n]
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 4 * seconds(8_000) + 0.2
    for text in ("(" * 200_000, "`" * 200_001, "x=>" * 20_000, "{" * 200_000 + ")" * 200_000, "foo(" * 100_000, '"' * 200_001, "/" * 200_000):
        for ext in (".py", ".go", ".js"):
            definition_spans(ext, text)


def test_generator_methods(files):
    text = "class A {\n  *gen() {\n    yield 1\n  }\n  static async *both() {\n  }\n  async* near(a, b) {\n  }\n  async plain() {\n  }\n  async() {\n  }\n  x = a * b(1)\n}\n"
    for path in ("a.js", "a.ts"):
        assert found(files, path, text) == [(1, 14, "", "A"), (2, 4, "gen", ""), (5, 6, "both", ""), (7, 8, "near", ""), (9, 10, "plain", ""), (11, 12, "async", "")]
