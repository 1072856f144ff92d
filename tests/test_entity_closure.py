from strataloom.operators import dotnet


def test_entities_by_base_names_and_any_depth(spark):
    steps = [("Order", "AuditableEntity"), *((f"C{k}", f"C{k - 1}" if k else "Shop.DomainEntity") for k in range(6)), ("P", "Q"), ("Q", "P"), ("Tool", "Helper")]
    files = [(f"src/{c}.cs", f"namespace Shop;\npublic class {c} : {b}\n{{\n    public int Id {{ get; set; }}\n}}\n") for c, b in steps]
    found = dotnet.entity_framework(spark.createDataFrame(files, "rel_path string, content string"))["data_entities"]
    assert {r.component_id for r in found.collect()} == {"Shop.Order", *(f"Shop.C{k}" for k in range(6))}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    written = dotnet.written
    monkeypatch.setattr(dotnet, "written", lambda df, what, by=(): (rounds.append(what), written(df, what, by))[1])
    known = spark.createDataFrame([("C0",)], "name string")
    chain = [(f"C{k + 1}", f"C{k}") for k in range(100)] + [("P", "Q"), ("Q", "P"), ("X", "Y")]
    found = dotnet._closure(known, spark.createDataFrame(chain, "name string, base string"))
    assert {r.name for r in found.collect()} == {f"C{k}" for k in range(101)}
    assert rounds.count("ways") <= 8
