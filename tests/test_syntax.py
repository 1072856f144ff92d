"""The table of declarations: brackets to any depth, comments and texts, indentation, the GraphQL grammar, the table function."""

import pytest

from strataloom.sources import syntax


def rows(language, text):
    names = [c.split(" ", 1)[0] for c in syntax.COLUMNS.split(", ", 9)]
    return [dict(zip(names, r, strict=True)) for r in syntax.parse(language, text)]


def types_of(language, text):
    return {r["name"]: r for r in rows(language, text) if r["kind"] != "file"}


def words(row):
    return [m.words for m in row["members"]]


def test_brackets_nest_to_any_depth():
    deep = "(" * 50 + '")"' + ")" * 50
    found = types_of("java", f"package a.b;\n@X{deep}\nclass A {{ @Y(k = {{1, {deep}}}) int f = g({deep}); void m(@Z({deep}) List<Map<A, B>> x, int y) {{ if (z) {{ h(); }} }} }}\nclass B {{ }}\n")
    a = found["A"]
    assert (a["space"], a["broken"], a["notes"][0].args.count("(")) == ("a.b", None, 49)
    field, method = a["members"]
    assert (field.words, field.notes[0].name, method.words) == ("int f", "Y", "void m")
    assert [(p.words, [n.name for n in p.notes]) for p in method.params] == [("List<Map<A, B>> x", ["Z"]), ("int y", [])]
    assert words(found["B"]) == []


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("java", '/* class A { */ class B { String s = "class C { // "; } // class D { }\n', ["B"]),
        ("csharp", '#region class A {\nclass B { string s = @"""class C {"; char c = \'{\'; }\n', ["B"]),
        ("protobuf", "message A { oneof x { int32 a = 1; } message B { } } // message C { }", ["A", "B"]),
        ("ruby", "module A\n class B\n def x\n if y\n end\n end\n end\nend\nclass C; end\n", ["A", "B", "C"]),
        ("python", 'class A:\n  """class B:"""\n  def f(self):\n    class C(A): pass\n# class D:\n', ["A", "C"]),
        ("graphql", '"""type A { x: Int }""" type B { x: Int } # type C', ["B"]),
        ("go", "type A struct {\n\tB struct { x int }\n\tC string `json:\"}\"`\n}\n", ["A"]),
    ],
)
def test_comments_and_texts_are_no_code(language, text, names):
    assert list(types_of(language, text)) == names and rows(language, text)[0]["broken"] is None


def test_bodies_end_where_indentation_ends():
    found = types_of("python", "class A(Base):\n\n    x = Column(Integer,\n  nullable=False)\n\n# note\n    class In:\n        y = 1\n    z: int = 2\ndef f():\n    q = 3\nclass B(A):\n    w = 4\n")
    assert words(found["A"]) == ["x", "z"] and words(found["In"]) == ["y"] and words(found["B"]) == ["w"]
    assert found["In"]["outer"] == "A" and "nullable" in found["A"]["members"][0].value


def test_broken_files_are_read_as_far_as_they_go():
    for language, text, names in [
        ("java", "class A { int x; void f() { ", ["A"]), ("java", "class A { } } ) class B { int y; }", ["A", "B"]), ("python", "class A:\n  x = f(\n", ["A"]),
        ("graphql", "type A { x: Int } type B { : }", ["A"]), ("ruby", "class A\n def x\n", ["A"]),
    ]:
        assert [n for n in types_of(language, text) if n in names] == names and rows(language, text)[0]["broken"]
    assert rows("graphql", "type A { x: " + "[" * 50_000)[0]["broken"]


def test_tables(spark):
    files = spark.createDataFrame([("a.java", "package p; class A { int x; }"), ("b.java", None), ("c.java", "")], "rel_path string, content string")
    found = syntax.declarations(files, "java").orderBy("rel_path", "part").collect()
    assert [(r.rel_path, r.kind, r.name) for r in found] == [("a.java", "file", None), ("a.java", "class", "A"), ("b.java", "file", None), ("c.java", "file", None)]
    assert found[1].members[0].words == "int x"
    unknown = syntax.declarations(files, "cobol").collect()
    assert len(unknown) == 3 and all(r.broken == "no parser for cobol" for r in unknown)
    syntax.register(spark)
    files.createOrReplaceTempView("sources")
    by_sql = spark.sql("SELECT s.rel_path, d.name, d.space FROM sources AS s, LATERAL declarations('java', s.content) AS d WHERE d.kind = 'class'").collect()
    assert [tuple(r) for r in by_sql] == [("a.java", "A", "p")]
