from pyspark.sql import functions as F

from claimloom.operators import registry, render


def test_entities_are_listed_with_their_types(rows):
    df = rows("e array<struct<canonical_name:string,entity_type:string>>", ([("Goitre", "Disease"), ("TSH", "Marker")],), ([],))
    assert [r[0] for r in df.select(render.entity_list(F.col("e"))).collect()] == ["- Goitre (Disease)\n- TSH (Marker)", ""]


def test_entities_get_the_entry_of_their_name_and_type(rows):
    terms = rows("term_id long, canonical string, entity_type string", (4, "TSH", "Marker"), (3, "TSH", "Marker"), (1, "TSH", "Gene"), (5, None, "Gene"))
    entities = rows("canonical_name string, entity_type string", ("TSH", "Marker"), ("TSH", "Drug"), ("TSH", None), (None, "Gene"))
    got = {(r["canonical_name"], r["entity_type"]): r["ontology"] for r in registry.enriched(entities, terms).collect()}
    assert got == {("TSH", "Marker"): 3, ("TSH", "Drug"): None, ("TSH", None): None, (None, "Gene"): None}
