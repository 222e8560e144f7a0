"""The stages against plain versions of what each has to do with its own input."""

import plain
from oracle import compare
from test_near_copies import survivors

import corpus_pipeline
from tablarium.llm import personal_data, queries
from tablarium.llm.common import materialize, read

SF = "/root/testdata/sf0.01"  # 399 labels; sf0.001 has 87, too few to hold rows for pruning


def test_chat_matches_sql(spark):
    compare(spark, queries.QUERIES["op2_chat"], queries.ORACLES["op2_chat"], SF)


def test_stages(spark):
    docs, kept = read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs, materialize(stage(spark, docs, SF))
        docs = kept[name][1]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {name: tuple({r.doc_id: r for r in x.collect()} for x in pair) for name, pair in kept.items()}
    before, after = rows["quality_rules"]
    bad = {r.doc_id for r in read(spark, SF, "labels").filter("quality = 0").collect()}
    assert all(not plain.quality(r.text)[-1] for r in after.values())
    assert len(after.keys() & bad) <= 2
    before, after = rows["near_duplicates"]
    # five words and a similarity of 0.8; the fingerprints of op6 (three words, three bits) are no measure of this stage
    assert sorted(after) == [k for _, k in survivors(sorted((k, r.text) for k, r in before.items()))]
    before, after = rows["decontamination"]
    found = plain.decontaminated([(k, r.text) for k, r in before.items()], [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()])
    assert set(after) == {k for k, x in found.items() if not x[-1]}
    before, after = rows["personal_data"]
    assert set(before) == set(after)
    clean = plain.personal("")
    for k, r in after.items():
        assert plain.personal(r.text) == clean and r.n_chars == len(r.text)
        if plain.personal(before[k].text) == clean:
            assert r.text == before[k].text or "[" in r.text
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(rows["packing"][1])
    assert personal_data.BASE == ("email", "ip", "card", "phone")
