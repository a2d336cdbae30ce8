import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from recon.llm.token_output import word_bpe
from tests.llm.test_decontaminate import slow as slow_leaks
from tests.llm.test_language_id import prose
from tests.llm.test_mixing import n_words, slow_targets
from tests.llm.test_simhash_dedup import slow_components, slow_fp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(3), []
    items = [(k, prose(rng, "aa", 40)) for k in range(5)]
    for i in range(260):
        lang = rng.choice(["aa", "bb", "cc"])
        text = prose(rng, lang, rng.randrange(30, 200))
        if i % 20 == 0:
            text += "\n" + items[i // 20 % 5][1] + " more"
        rows.append((i, text, lang, rng.choice(["s1", "s1", "s1", "s2", "s3", None])))
    rows += [(1000 + i, rows[i][1], rows[i][2], "s2") for i in range(0, 60, 3)]
    rows += [(2000, None, "aa", "s1"), (2001, "12 34 56", "bb", "s2"), (2002, "", "cc", "s1")]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{path}/{name}")
    kept = {name: {r.doc_id: r.text for r in seen[name].collect()} for name in ("language_id", "near_dedup", "decontaminate")}
    assert set(kept["language_id"]) == {r[0] for r in rows} - {2000, 2001, 2002}
    parts = slow_components({i: slow_fp(t) for i, t in kept["language_id"].items()}, 3)
    assert set(kept["near_dedup"]) == {i for i, c in parts.items() if i == c} and len(kept["near_dedup"]) < len(parts)
    leaky = {d for d, _ in slow_leaks(list(kept["near_dedup"].items()), items)}
    assert leaky and set(kept["decontaminate"]) == set(kept["near_dedup"]) - leaky
    source, sizes, got = {r[0]: r[3] for r in rows}, Counter(), defaultdict(int)
    for i, t in kept["decontaminate"].items():
        sizes[source[i]] += n_words(t)
    mixed = seen["mix"].collect()
    for r in mixed:
        got[r.source] += n_words(r.text)
    assert dict(got) == {s: round(t) for s, t in slow_targets(sizes).items()}
    tokenizer = Tokenizer.from_file(word_bpe())
    want = Counter()
    for r in mixed:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    final = sorted(seen["token_files"].collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in final) == want
    assert [r.start for r in final] == list(np.cumsum([0] + [r.n_tokens for r in final])[:-1]) and [r.doc_id for r in final] == sorted(r.doc_id for r in final)


def test_run_is_the_stages(spark, folder):
    path = folder[0]
    got = corpus_pipeline.run(spark, path)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, spark.read.parquet(f"{path}/token_files").collect()))
