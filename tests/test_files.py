"""Imports and package names in source texts."""

import pytest

from weftline.sources import files

TEXTS = [
    ("ts", 'import React, { useState as s, type X } from "react";\nimport type { A } from \'./a\'\nimport * as fs from "fs";\nimport "side";\nconst x = require("req"), y = await import("dyn");\nimport {\n  one,\n  two\n} from "lines";\nimportant("no");', [("react", ["React", "useState", "type"]), ("./a", ["A"]), ("fs", ["fs"]), ("lines", ["one", "two"]), ("side", []), ("dyn", []), ("req", [])]),
    ("py", "from a.b import c, d as e  # x\nimport os, sys as s\n  from .rel import (f,\n  g)\nfrom x import *\nimportant = 1", [("a.b", ["c", "d"]), (".rel", ["f"]), ("x", ["*"][:0]), ("os", []), ("sys", [])]),
    ("java", "package p;\nimport a.b.C;\nimport static a.B.f; // x\nimport a.c.*;\nclass X { int imports; }", [("a.b.C", []), ("a.B.f", []), ("a.c", [])]),
    ("cs", "using System.Text;\nusing static A.B;\nglobal using G;\nusing F = C.D;\nusing (var s = Open());\nusing var t = u;\n", [("System.Text", []), ("A.B", []), ("C.D", [])]),
]


@pytest.mark.parametrize(("lang", "text", "want"), TEXTS)
def test_imports(spark, lang, text, want):
    rows = spark.createDataFrame([("f", text), ("empty", ""), ("none", None)], "file string, content string")
    got = [(r["module"], r["names"]) for r in files.imports_of(rows, lang).collect()]
    assert got == want


POM = '<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>up</groupId><artifactId>no</artifactId></parent>{}<artifactId> art </artifactId><dependencies><dependency><groupId>d</groupId><artifactId>dep</artifactId></dependency></dependencies></project>'


@pytest.mark.parametrize(("name", "content", "want"), [
    ("package.json", '{"name": "@x/y"}', "@x/y"),
    ("package.json", "{", None),
    ("pom.xml", POM.format("<groupId>g.h</groupId>"), "g.h:art"),
    ("pom.xml", POM.format(""), "up:art"),
    ("pom.xml", "<project><artifactId>", None),
    ("pom.xml", "not xml", None),
    ("pom.xml", None, None),
    ("A.csproj", "<Project><PropertyGroup><X>1</X></PropertyGroup><PropertyGroup><AssemblyName>Asm</AssemblyName></PropertyGroup></Project>", "Asm"),
    ("B.csproj", "<Project><PropertyGroup><X>1</X></PropertyGroup></Project>", None),
    ("c.txt", "<Project/>", None),
])
def test_package_names(spark, name, content, want):
    rows = spark.createDataFrame([(name, content)], "name string, content string")
    assert rows.select(files.package_name(rows["name"], rows["content"]).alias("p")).first()["p"] == want
