"""Project files and what follows from them."""

from test_project import index, warnings, write

from sparkweave import api
from sparkweave.sources import projects

LIB = '<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework><RootNamespace>My.Lib</RootNamespace></PropertyGroup></Project>'
TESTS = '<Project><ItemGroup><PackageReference Include="xunit" Version="2" /></ItemGroup></Project>'


def test_project_files(tmp_path):
    root = str(tmp_path)
    write(root, {"lib/Lib.csproj": LIB, "lib/tests/T.csproj": TESTS.encode("utf-16"), "App.csproj": "<Project><OutputType>Exe</OutputType></Project>", "Cargo.toml": '[[bin]]\nname = "x"\npath = "tools/run.rs"\n', "sub/Cargo.toml": "broken = ["})
    rows = {r[0]: r for r in projects.csharp_projects(root)}
    assert rows["lib"][1:] == ("Lib", False, "Library", "net8.0", "Lib", "My.Lib") and rows["lib/tests"][2] is True and rows[""][3] == "Exe"
    assert projects.cargo_binaries(root) == ["tools/run.rs"]


def test_entries_of_projects(spark, tmp_path):
    root = str(tmp_path)
    write(
        root,
        {
            "lib/Lib.csproj": LIB, "lib/A.cs": "namespace N;\npublic class A { public void F() { Help(); } void Help() {} void Lost() {} }\n", "lib/tests/T.csproj": TESTS, "lib/tests/B.cs": "public class B { public void G() {} }\n",
            "Cargo.toml": '[[bin]]\nname = "x"\npath = "tools/run.rs"\n', "tools/run.rs": "fn go() { help(); }\nfn help() {}\n", "other.rs": "fn lost() {}\n",
        },
    )
    api.build(root_dir=root, spark=spark)
    dead = {n for w, n in warnings(spark, root) if w == "dead_code"}
    assert dead == {"N.A.Lost", "crate::other::lost"}
    assert {r["rule_name"] for r in index(spark, root).read("entries").collect()} == {"csharp_library", "csharp_test_project", "cargo_bin"}
