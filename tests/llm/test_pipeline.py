import re

import corpus_pipeline as P
from cohortry.llm.common import saved


def test_stages(spark):
    docs = P.documents(spark, "/root/testdata/sf0.001")
    before = docs.count()
    count = []
    for name, stage in P.STAGES:
        docs = saved(stage(spark, docs, "/root/testdata/sf0.001"), name)
        count.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == count[-1]
        if name == "repeated_passages":
            seen = {}
            for r in docs.collect():
                assert r.n_chars == len(r.text) > 0 and re.search(r"\S", r.text)
                seen.setdefault(r.text, r.doc_id)
    assert before >= count[0] >= count[1] >= count[2] > 0
    assert docs.where("not exact").count() == 0
