"""Links across files: bindings by language, uses in code, the join against brute force, and the tools over a project that changes."""

import json
import random

import pytest

from lodestone.api import Tools
from lodestone.config import Config, Index
from lodestone.functions import bindings
from lodestone.operators import links

PROJECT = {
    "pkg/__init__.py": "from .core import build\n\ndef top():\n    return build()\n",
    "pkg/core.py": "class Box:\n    @staticmethod\n    def fold(x):\n        return x\n\ndef build(n):\n    return Box.fold(n)\n",
    "pkg/sub/__init__.py": "",
    "pkg/sub/use.py": "import pkg.core as c\nimport pkg.core\nfrom ..core import build as make, Box\nfrom pkg import top\n\ndef first():\n    return make(1)\n\ndef second():\n    # top()\n    s = 'top()'\n    return pkg.core.build(2), c.Box.fold(3)\n\ndef third(build):\n    return top()\n",
    "star.py": "from pkg.core import *\n\ndef open_scope():\n    return build(4)\n",
    "web/lib.ts": "export function render(a) {\n  return a;\n}\nexport class View extends Base {\n}\n",
    "web/menu/index.js": "export function menu(a) {\n  return a;\n}\n",
    "web/app.js": "import { render as draw, View } from './lib';\nimport menu from './menu';\nimport * as lib from \"./lib.ts\";\nconst { menu: other } = require('./menu');\nfunction start(a) {\n  return draw(new View(menu(a)));\n}\nfunction again(a) {\n  return lib.render(other(a));\n}\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tu "example.com/m/util"\n)\n\nfunc main() {\n\tfmt.Println(u.Sum(1), local(2))\n}\n',
    "cmd/more.go": "package main\n\nfunc local(a int) int {\n\treturn a\n}\n",
    "util/sum.go": "package util\n\nfunc Sum(a int) int {\n\treturn a\n}\n",
    "other/util/sum.go": "package util\n\nfunc Sum(a int) int {\n\treturn a\n}\n",
    "net/Tool.cs": "namespace Acme.Tools\n{\n  public class Tool\n  {\n    public static int Turn(int a)\n    {\n      return Half(a);\n    }\n    public static int Half(int a)\n    {\n      return a;\n    }\n  }\n}\n",
    "net/User.cs": "using Acme.Tools;\nusing T = Acme.Tools.Tool;\nnamespace Acme.App\n{\n  public class User\n  {\n    public int Go(int a)\n    {\n      return Tool.Turn(a);\n    }\n    public int Back(int a)\n    {\n      return T.Half(a);\n    }\n  }\n}\n",
}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "p"
    for name, text in PROJECT.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return base.resolve()


def test_bindings():
    of = bindings.of_file
    assert of("import a.b, c.d as e\nfrom .x import y as z\nfrom .. import w\nfrom q import *", "python", "p.m", "/w/p/m.py", "/w") == [
        ("a", "python:a"), ("e", "python:c.d"), ("z", "python:p.x.y"), ("w", "python:w"), ("", "python:q"), ("", "python:p.m"),
    ]
    assert of("from .x import y", "python", "p.__init__", "/w/p/__init__.py", "/w") == [("y", "python:p.x.y"), ("", "python:p")]
    assert of("def (", "python", "p", "/w/p.py", "/w") == [] and of("import a", "rust", "", "/w/a.rs", "/w") == [] and of(None or "", "go", "", "/w/a/b.go", "/w") == [("", "go:/w/a")]
    assert of("import D, { a as b } from '../lib.js'; import 'side'; import x from 'package'", "javascript", "", "/w/s/t/app.js", "/w")[:2] == [("b", "script:/w/s/lib.a"), ("D", "script:/w/s/lib.D")]
    assert of('import "m/v2"\nimport . "k"\nimport _ "n"', "go", "", "/w/a.go", "/w") == [("m", "go:/w/m/v2"), ("m", "go:/w/v2"), ("", "go:/w/k"), ("", "go:/w")]
    assert of("using A.B; using C = D.E; namespace N.M { }", "csharp", "", "/w/a.cs", "/w") == [("", "csharp:A.B"), ("C", "csharp:D.E"), ("", "csharp:N.M"), ("", "csharp:N")]


def test_references(spark):
    texts = [("python", "def f(a):\n    # no(x)\n    s = 'no2()' + \"\"\"no3()\n\"\"\"\n    return g.h (a), g.h, b()[0].not_this"), ("go", "a.B(c) // no\n/* no() */ `no`"), ("python", "'" + "x\\'" * 200_000 + "'"), ("python", None)]
    rows = spark.createDataFrame(texts, "language string, code string")
    got = [r.w for r in rows.select(links.references(rows.code, rows.language).alias("w")).collect()]
    assert set(got[0]) == {"def", "f(", "a", "s", "return", "g.h(", "b("} and set(got[1]) == {"a.B(", "c"} and got[2:] == [[], None]


def brute(used, keys):
    out = set()
    for w, path, symbol, line, own, ref, targets in used:
        tried = [(less, place, t.rsplit(".", less)[0]) for place, t in enumerate(targets) for less in range(min(ref.count("."), t.count(".")) + 1)]
        hits = [x for x in tried if (w, x[2]) in keys]
        if hits and min(hits)[2] != own:
            out.add((w, path, symbol, line, ref, own, min(hits)[2]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_linked_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    name = lambda n: ".".join(rng.choices("abc", k=n))
    keys = {(rng.choice("uv"), f"python:{name(rng.randint(1, 4))}") for _ in range(25)}
    used = {}
    for k in range(200):
        ref = name(rng.randint(1, 3))
        used[k] = (rng.choice("uv"), f"/f{k % 9}", f"s{k}", k, f"python:{name(2)}", ref, [f"python:{name(rng.randint(1, 2))}.{ref}" for _ in range(rng.randint(1, 3))])
    form = "workspace_id string, file_path string, symbol string, start_line int, own string, ref string, targets array<string>"
    exports = spark.createDataFrame([*keys, *keys], "workspace_id string, key string")
    got = links.linked(spark.createDataFrame(list(used.values()), form), exports).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(used.values(), keys)
    assert links.linked(spark.createDataFrame([], form), exports).count() == 0


def test_callers_in_all_languages(spark, tmp_path, root):
    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "i"))))
    t.index_project(str(root), workspace_id="w")

    def ask(name, direction="callers"):
        given = "source_symbol" if direction == "callers" else "target_symbol"
        rows = json.loads(t.find_implementations(name, direction, "w", "json"))["results"]
        return {(r[given], r["file_path"].removeprefix(f"{root}/")) for r in rows if r["file_path"]}

    assert ask("build") == {("top", "pkg/__init__.py"), ("first", "pkg/sub/use.py"), ("second", "pkg/sub/use.py"), ("open_scope", "star.py")}
    assert ask("fold") == {("build", "pkg/core.py"), ("second", "pkg/sub/use.py")}
    assert ask("top") == {("third", "pkg/sub/use.py")}
    assert ask("render") == {("start", "web/app.js"), ("again", "web/app.js")} and ask("View") == {("start", "web/app.js")} and ask("menu") == {("start", "web/app.js"), ("again", "web/app.js")}
    assert ask("Sum") == {("main", "cmd/main.go")} and ask("local") == {("main", "cmd/main.go")}
    # A type's text holds that of its methods, so it uses what they use.
    assert ask("Turn") == {("Go", "net/User.cs"), ("User", "net/User.cs")} and ask("Half") >= {("Back", "net/User.cs"), ("Turn", "net/Tool.cs")}
    assert ask("main", "targets") == {("Sum", "util/sum.go"), ("local", "cmd/more.go")}
    assert ask("second", "targets") == {("build", "pkg/core.py"), ("fold", "pkg/core.py")}
    # What defines a name may come and go, without its users being read again.
    (root / "pkg" / "core.py").write_text("def build(n):\n    return n\n")
    (root / "util" / "sum.go").unlink()
    t.index_project(str(root), workspace_id="w")
    assert ask("fold") == set() and ask("Sum") == set() and ask("build") >= {("first", "pkg/sub/use.py")}
    (root / "util" / "again.go").write_text("package util\n\nfunc Sum(a int) int {\n\treturn a\n}\n")
    t.index_project(str(root), workspace_id="w")
    assert ask("Sum") == {("main", "cmd/main.go")} and ask("main", "targets") == {("Sum", "util/again.go"), ("local", "cmd/more.go")}
