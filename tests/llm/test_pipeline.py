"""The pipeline against a brute-force version of its decisions."""

import random

import pytest

from helixframe.llm import toxicity
from tests.llm.test_jaccard import brute_classes
from tests.llm.test_native_operators import brute_count

pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(9)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "nu", "ta", "so"]) for _ in range(r.randrange(2, 5)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(r.randrange(20, 50))]
        if i % 4 == 0:
            words[3] = words[9] = words[14] = r.choice(["grumblor", "snarkwit"])
        labels.append((i, int(i % 4 == 0), 1))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
    base = rows[1][1].split()
    rows += [(400 + k, " ".join([*base[:-1], f"end{k}"]), "en", "s1", 1) for k in range(5)]
    rows += [(500, None, "en", "s1", 0), (501, "", "en", None, 0), (502, " ".join(word() for _ in range(40)) + " jo.doe7@mail1.example.com or 10.20.30.44", "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], str(tmp_path)).cache())
        assert seen[-1].columns == docs.columns, name
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    fine = [(i, t) for (i, t, *_), s in zip(rows, model.scores([t or "" for _, t, *_ in rows])) if s < 0.5]
    assert sorted(x.doc_id for x in seen[1].collect()) == sorted(i for i, _ in fine)
    assert {i for i, y, _ in labels if y} - {i for i, _ in fine} and {i for i, y, _ in labels if not y} <= {i for i, _ in fine}
    label = brute_classes(fine, pipeline.SHINGLE, pipeline.NUM, pipeline.DEN)
    kept = sorted(i for i, _ in fine if label[i][1] == i)
    assert sorted(x.doc_id for x in seen[2].collect()) == kept and 1 in kept and not {400, 401, 402, 403, 404} & set(kept)
    clean = {x.doc_id: x.text for x in seen[3].collect()}
    assert sorted(clean) == kept and "jo.doe7" not in clean[502] and "10.20.30.44" not in clean[502]
    assert all(clean[i] == t for i, t in fine if i in clean and i != 502)
    source = {i: s for i, _, _, s, _ in rows}
    mass = {}
    for i, t in clean.items():
        mass[source[i]] = mass.get(source[i], 0) + len(t or "")
    total, weight = sum(mass.values()), {s: m**0.5 for s, m in mass.items()}
    times = {i: brute_count(i, weight[source[i]] / sum(weight.values()) * total / mass[source[i]] if mass[source[i]] else 1.0) for i in clean}
    mixed = [x.doc_id for x in seen[4].collect()]
    assert {i: mixed.count(i) for i in clean} == times
    coder = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokens = {}
    for x in pipeline.run(spark, str(tmp_path)).collect():
        tokens[x.doc_id] = tokens.get(x.doc_id, 0) + x.length
    assert tokens == {i: n * (len(coder.encode(clean[i] or "", add_special_tokens=False).ids) + 1) for i, n in times.items() if n}
