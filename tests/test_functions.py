import json

import pytest
from pyspark.sql import functions as F

from lodestone.config import EXCLUDES, EXTENSIONS, Config, Search, build, load_config
from lodestone.functions import imports, paths, tags, text
from lodestone.operators import resolve
from lodestone.sources import workspaces


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "k").orderBy("k").select("x").collect()]


def test_language(spark):
    given = {"a.py": "python", "A.PY": "python", "x.tsx": "typescript", "x.mjs": "javascript", "q.h": "cpp", "r.md": "doc", "c.toml": "config", "y.env": "config", ".env": None, ".DS_Store": None, "package-lock.json": None, "Cargo.lock": None, "a.min.js": None, "Makefile": None}
    assert column(spark, list(given), paths.language_of) == list(given.values())


def test_exclusion(spark):
    given = {"/r/.git/x": True, "/r/a/node_modules/b.js": True, "/r/package-lock.json": True, "/r/Gemfile.lock": True, "/r/a.min.js": True, "/r/x.egg-info/y": True, "/r/src/a.py": False, "/r/builder/a.py": False, "/build/r/a.py": False}
    assert column(spark, list(given), lambda p: paths.is_excluded(p, EXCLUDES, "/build/r")) == list(given.values())
    assert column(spark, ["/build/a.py"], lambda p: paths.is_excluded(p, EXCLUDES)) == [True]


def test_suffix_and_glob(spark):
    assert column(spark, ["/a/b.tar.gz", "/a/.env", "/a/x.", "/a.b/c"], paths.suffix_of) == [".gz", "", "", ""]
    assert column(spark, ["/a/b.py", "/a/b.PY", "/a/.env"], lambda p: paths.supported(p, EXTENSIONS)) == [True, False, False]
    assert column(spark, ["/a/b1.py", "/a/c/b2.py", "/a/b9.js", "/a/ba.py"], lambda p: paths.matches_glob(p, "/a/*b[0-9].p?")) == [True, True, False, False]
    assert column(spark, ["/a/bx.py", "/a/b1.py"], lambda p: paths.matches_glob(p, "*b[!0-9].py")) == [True, False]
    assert column(spark, ["/w/x/y.py", "z.py", "s/t.py"], paths.top_folder) == ["w", "z.py", "s"]


def test_path_tags(spark):
    given = {
        "/p/tests/a.py": ["lang:python", "type:test"], "/p/a_test.py": ["lang:python", "type:test"], "/p/test_a.py": ["lang:python"], "/p/api/user_route.go": ["lang:go", "layer:api"], "/p/docs/x.md": ["lang:doc", "type:doc"],
        "/p/router.js": ["lang:javascript", "layer:api"], "/p/models/auth_middleware.ts": ["lang:typescript", "layer:middleware", "layer:model"], "/p/c.yaml": ["lang:config", "type:config"], "/p/core/utils/z.bin": ["layer:service", "layer:utils"],
    }
    assert column(spark, list(given), lambda p: tags.path_tags(p, paths.language_of(p))) == list(given.values())


def test_valid_and_answered_tags(spark):
    assert column(spark, [["framework:flask", "framework:odd", "purpose:api", "x", "lang:a:b", "lang:a:b"]], tags.valid_tags, "array<string>") == [["framework:flask", "lang:a:b", "purpose:api"]]
    assert column(spark, ['{"tags": [" a:b ", "c"]}', "{}", "nonsense", "[1]", None], tags.answered_tags) == [["a:b", "c"], [], None, None, None]


def test_text(spark):
    assert column(spark, ["a\x00b\tc\x7f\x85d"], text.sanitized) == ["ab\tcd"]
    assert column(spark, [bytearray(b"ab\xffc\xc3\xa9")], text.decoded, "binary") == ["abcé"]
    assert column(spark, ["Process_Data.x café ÄÖ1", None, ""], text.tokens) == [["process", "data", "x", "cafe", "ao1"], [], []]
    assert column(spark, ["/w"], text.workspace_id) == [workspaces.id_of("/w")]
    assert column(spark, ["s"], lambda s: text.embed_text(s, F.lit(""), F.lit("code"), 4)) == ["s\nco"]


def test_flat_metadata(spark):
    given = ['{"k": "v", "n": 1.5, "t": true, "l": [1, "a"], "o": {"x": null}, "z": null}', "{}", None, "[1]"]
    flat = column(spark, given, lambda v: F.to_json(text.flat_metadata({"a": F.lit(3), "b": F.length(v), "none": F.lit(None).cast("string")}, F.parse_json(v))))
    assert [json.loads(x) for x in flat] == [{"a": 3, "b": 75, "meta_k": "v", "meta_n": 1.5, "meta_t": True, "meta_l": '[1,"a"]', "meta_o": '{"x":null}'}, {"a": 3, "b": 2}, {"a": 3}, {"a": 3, "b": 3}]


def test_imports(spark):
    assert imports.python_modules("import a.b, c\nfrom . import d\nfrom ..e import f\n") == ["a.b", "c", "e"]
    assert imports.python_modules("def (") == []
    js = 'import a from "x"\nimport "y"\nimport {b} from \'x\'\nconst z = require("q")'
    assert column(spark, [js], lambda s: F.array_sort(imports.script_imports(s))) == [["x", "y"]]
    go = 'import "fmt"\nimport (\n "os"\n a "skip"\n // "no"\n)'
    assert column(spark, [go], lambda s: F.array_sort(imports.go_imports(s))) == [["fmt", "os"]]
    assert column(spark, ["using System;\nusing A.B ;"], imports.csharp_imports) == [["System", "A.B"]]


def test_resolution(spark):
    files = ["/w/a/__init__.py", "/w/a/b.py", "/w/js/x.js", "/w/js/lib/index.ts", "/w/node_modules/p/index.js", "/w/go/m/z.go", "/w/go/m/main.go", "/w/go/n/k.go", "/w/cs/T.cs"]
    listing = spark.createDataFrame([(f, "namespace My.App {" if f.endswith(".cs") else "") for f in files], "file_path string, source string")
    asked = [
        ("/w/a/c.py", "python", ".b", "/w/a/b.py"), ("/w/a/c.py", "python", "a", "/w/a/__init__.py"), ("/w/a/c.py", "python", "a.b", "/w/a/b.py"), ("/w/a/c.py", "python", "os", None), ("/w/js/y.js", "javascript", "./x", "/w/js/x.js"),
        ("/w/js/s/y.js", "javascript", "../lib", "/w/js/lib/index.ts"), ("/w/js/y.js", "javascript", "p", "/w/node_modules/p/index.js"), ("/w/go/q.go", "go", "go/m", "/w/go/m/main.go"), ("/w/go/q.go", "go", "go/n", "/w/go/n/k.go"),
        ("/w/cs/U.cs", "csharp", "My.App", "/w/cs/T.cs"), ("/w/cs/U.cs", "csharp", "Other", None),
    ]
    rows = resolve.resolved(spark.createDataFrame([a[:3] for a in asked], "source_file string, language string, `import` string"), listing, "/w").collect()
    assert {(r.source_file, r.language, r["import"]): r.resolved_path for r in rows} == {a[:3]: a[3] for a in asked}


def test_workspaces(spark, tmp_path):
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "Foo.csproj").write_text("")
    found = workspaces.detect(str(tmp_path / "p" / "q"))
    assert (found.marker_type, found.name, len(found.id)) == (".csproj", "p", 12)
    (tmp_path / "p" / "go.mod").write_text("")
    assert workspaces.detect(str(tmp_path / "p" / "q")).marker_type == "go.mod"
    listing = spark.createDataFrame([("/r/pyproject.toml",), ("/r/s/go.mod",), ("/r/s/package.json",), ("/r/s/t/a.go",), ("/r/b.py",), ("/o/x.py",)], "file_path string")
    rows = {r.file_path: (r.root, r.marker_type) for r in workspaces.roots(listing).collect()}
    assert rows["/r/s/t/a.go"] == ("/r/s", "go.mod") and rows["/r/b.py"] == ("/r", "pyproject.toml") and "/o/x.py" not in rows


def test_config(tmp_path):
    assert Config().search.alpha == 0.6
    with pytest.raises(ValueError):
        Search(0.7, 0.4)
    with pytest.raises(ValueError):
        build(Config, {"index": {"nothing": 1}})
    (tmp_path / "c.yaml").write_text("index:\n  index_path: idx\n  exclude_patterns: ['a']\nsearch: {alpha: 0.5, beta: 0.5}\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert c.index.index_path == str(tmp_path / "idx") and c.index.exclude_patterns == ("a",) and c.search.beta == 0.5
