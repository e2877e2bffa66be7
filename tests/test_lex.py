from __future__ import annotations

import pyarrow as pa
import pytest

from codelens.operators.lex import functions, functions_in, masked, parsed

SOURCE = '''#include <stdio.h>
/* int not_one(void) { return 1; } */
int proto(int a);
static int
add(int a,
    int b)
{
    const char *s = "} { (";   // }
    char c = '}';
    return a + b;
}

struct pair { int a; };
void Box::fill(int n) {
    if (n) { n--; }
}
int table[] = { 1, 2 };
'''


def test_masking_keeps_length_and_lines():
    clear = masked(SOURCE)
    assert len(clear) == len(SOURCE)
    assert [len(x) for x in clear.split("\n")] == [len(x) for x in SOURCE.split("\n")]
    assert "not_one" not in clear and '"' not in clear


def test_functions_of_a_file():
    found = list(functions_in(SOURCE))
    assert [f[0] for f in found] == ["add", "Box::fill"]
    name, start, brace, end, signature, body, clear = found[0]
    assert (start, brace, end) == (4, 7, 11)
    assert signature == "static int add(int a, int b)"
    assert body.startswith("{") and body.endswith("}") and len(body) == len(clear)


@pytest.mark.parametrize("text", ["", "{", "}", "int f(", "int f() {", "/* open", '"open', "a = b(c) { d; }", "\n" * 5, "if (x) { y(); }"])
def test_odd_files_have_no_function(text):
    assert list(functions_in(text)) == []


def test_files_with_nulls_and_same_names(spark):
    files = spark.createDataFrame([("a.c", "int f(void) { g(); }\nint f(int x) { return x; }"), ("b.c", "int f(void) { }"), ("c.c", None), ("d.c", "")], "path string, content string")
    got = functions(files).select("path", "fn", "ordinal").orderBy("path", "ordinal").collect()
    assert [tuple(r) for r in got] == [("a.c", "f", 0), ("a.c", "f", 1), ("b.c", "f", 0)]


@pytest.mark.parametrize("gap", [" " * 2000, "/* " + "c" * 2000 + " */", "// c\n" * 300])
def test_functions_with_long_gaps(gap):
    found = list(functions_in(f"int f(int a) {gap}\n{{ return a; }}\nint g {gap}\n(int b)\n{{ return b; }}\nint {'h' * 700}(void) {{ }}"))
    assert [f[0] for f in found] == ["f", "g", "h" * 700]


def test_functions_leave_the_worker_in_small_batches():
    body = "    work(x);\n" * 2_000
    files = pa.RecordBatch.from_pydict({"path": [f"f{k}.c" for k in range(200)], "content": [f"int f{k}(int x) {{\n{body}}}\n" for k in range(200)]})
    out = list(parsed(iter([files])))
    assert sum(b.num_rows for b in out) == 200
    assert max(b.nbytes for b in out) < 2_000_000
