from lodestone.operators import chunks

PYTHON = '''"""Module."""
import os

@deco
def f(a, b: int = 1) -> str:
    """Doc."""
    return "x"

async def _g():
    pass

class C(Base, metaclass=M):
    """About C."""
    x = 1

    @staticmethod
    def s():
        pass

    async def m(self):
        pass

    class Inner:
        def no(self): ...

if True:
    def hidden(): ...
'''


def test_python():
    got = chunks.python_symbols(PYTHON, "pkg")
    assert [(s.type, s.name, s.package, s.start_line, s.end_line) for s in got] == [("function", "f", "pkg", 5, 7), ("function", "_g", "pkg", 9, 10), ("class", "C", "pkg", 12, 24), ("method", "s", "pkg.C", 17, 18), ("method", "m", "pkg.C", 20, 21)]
    assert got[0].signature == "def f(a, b: int=1) -> str" and got[0].docstring == "Doc."
    assert got[1].metadata == {"is_async": True, "visibility": "private"}
    assert got[2].signature == "class C(Base)" and got[3].metadata["is_static"] is True
    assert chunks.python_symbols("def (", "p") == [] and chunks.python_symbols("", "p") == []
    assert len(chunks.python_symbols('def f():\n    """' + "x" * 3000 + '"""', "p")[0].docstring) == 2000


def test_script():
    source = "// c\nexport class A extends B {\n  m() { return '}'; }\n}\nexport async function f(a, b) {\n  if (a) { return `}`; }\n}\nfunction g() {}\nclass D {}"
    got = chunks.script_symbols(source, "p")
    assert [(s.type, s.name, s.start_line, s.end_line) for s in got] == [("class", "A", 2, 4), ("class", "D", 9, 9), ("function", "f", 5, 7), ("function", "g", 8, 8)]
    assert got[0].signature == "class A extends B" and got[2].signature == "async function f(a, b)" and got[2].metadata == {"is_async": True}


def test_go():
    source = "package calc\n\nfunc (c *Calc) Add(a, b int) (int, error) {\n\tif a > 0 {\n\t\treturn a, nil\n\t}\n\treturn b, nil\n}\n\nfunc Top(x string) {\n}\n\ntype Calc struct {\n\tA int\n}\ntype R interface {\n}\n"
    got = chunks.go_symbols(source, "x")
    assert [(s.type, s.name, s.package, s.start_line, s.end_line) for s in got] == [("method", "Add", "calc", 3, 8), ("function", "Top", "calc", 10, 11), ("class", "Calc", "calc", 13, 15), ("class", "R", "calc", 16, 17)]
    assert got[0].signature == "func (c *Calc) Add(a, b int) (int, error)" and got[0].metadata == {"is_method": True, "receiver_type": "*Calc"}
    assert got[3].metadata == {"type_kind": "interface"}


def test_csharp():
    source = "using X;\nnamespace My.App\n{\n    public class Svc\n    {\n        public static async Task<int> Run(int a)\n        {\n            await Go(a);\n            return Calc(a);\n        }\n    }\n    internal interface I { }\n    struct P { }\n}\n"
    got = chunks.csharp_symbols(source, "x")
    assert [(s.type, s.name, s.start_line, s.end_line) for s in got] == [("class", "Svc", 4, 11), ("class", "I", 12, 12), ("class", "P", 13, 13), ("method", "Run", 6, 10)]
    assert {s.package for s in got} == {"My.App"} and got[1].metadata == {"class_kind": "interface"}
    assert got[3].metadata == {"is_async": True, "is_static": True, "class_name": "Svc"} and got[3].signature == "Task<int> Run(int a)"


def test_router_and_table(spark):
    assert chunks.symbols("a\nb", "/x/r.rs", "rust", "p")[0].type == "config"
    assert chunks.symbols("a\nb", "/x/r.md", "doc", "p")[0].end_line == 2
    assert chunks.symbols("a", "/x/r", None, "p") == []
    rows = [("w", "/a.py", "python", "a", "def f(): pass"), ("w", "/b.md", "doc", "b", "x\n"), ("w", "/c.py", "python", "c", "def ("), ("w", "/d.go", "go", "d", None), ("w", "/e.json", "config", "e", "")]
    files = spark.createDataFrame(rows, "workspace_id string, file_path string, language string, package string, source string")
    got = sorted((r.file_path, r.type, r.name, r.start_line, r.end_line) for r in chunks.chunk_files(files).collect())
    assert got == [("/a.py", "function", "f", 1, 1), ("/b.md", "doc", "b.md", 1, 2), ("/e.json", "config", "e.json", 1, 1)]
    assert chunks.chunk_files(files.limit(0)).count() == 0
