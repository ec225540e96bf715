import corpus_pipeline
import numpy as np
import public_tokenizers
from test_line_dedup import plain as plain_lines
from test_minmax_dedup import plain as plain_near
from test_mixing import draw_number, plain_mix
from test_quality import plain as plain_quality

from tessella.llm import line_dedup, mixing, packing, quality
from tessella.llm.common import written


def test_each_stage_against_a_plain_version(spark, documents, words, tmp_path):
    def prose(seed, n=12):
        return "\n".join(words(14, 100 * seed + i).capitalize() + "." for i in range(n))

    rows = [(i, prose(i)) for i in range(60)] + [(100 + i, prose(i)) for i in range(5)] + [(200 + i, prose(7) + "\n" + words(12, i) + ".") for i in range(5)]
    rows += [(300, "too short"), (301, None), (302, "\n".join(words(9, i) for i in range(6)))]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps, made = [], docs
    for _, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, made, str(tmp_path)), "test")
        steps.append(made)
    assert all(s.columns == docs.columns for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in (docs, *steps[:-1])]

    assert set(texts[1]) <= {d for d, t in rows if not plain_quality(t)[-1]} and set(range(60)) <= set(texts[1]) and 302 not in texts[1]
    kept = plain_lines(list(texts[1].items()), line_dedup.LONG)
    rebuilt = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if kept.get((d, i), (1,))[-1]) for d, t in texts[1].items()}
    assert texts[2] == {d: t for d, t in rebuilt.items() if t.strip()}
    assert set(texts[3]) == {d for d, (_, _, stays) in plain_near(list(texts[2].items()), 5, 80).items() if stays}
    given = [(r.doc_id, r.text, r.lang, r.source) for r in steps[2].collect()]
    assert set(texts[4]) == {d for d, _, _, chance in plain_mix(given, {}, mixing.KEEP) if draw_number(d) < chance} < set(texts[3])
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert steps[4].selectExpr("sum(length)").first()[0] == sum(len(encoder.plain(t)) + 1 for t in texts[4].values())
    assert np.all([p.length <= packing.LENGTH for p in steps[4].collect()])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps[4].count()
    assert quality.clean(docs).count() == len(texts[1])


def test_odd_tables(spark, documents, words, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0

    def prose(seed):
        return "\n".join(words(14, 100 * seed + i).capitalize() + "." for i in range(8))

    rows = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(12)] * 2 + [(None, prose(50), None, None, None), (20, None, "en", "s", 0), (21, " \n", "en", "s", 1)]
    extra = dict.fromkeys(["_doc", "_gone", "line", "key", "topic", "mass", "kept", "component_id", "row", "curve", "_tokens"], "theirs")
    documents(rows, extra).write.parquet(f"{tmp_path}/odd/documents.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [p.doc_id for p in pieces if not p.start]
    assert len(ids) == len(set(ids)) and {None, 20, 21} & set(ids) <= {None} and len(ids) >= 6
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if not p.start)
