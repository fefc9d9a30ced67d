"""What the latent space of decontamination is fitted to."""

import random

from cladeworks.llm import decontamination


def test_space_of_all_items(spark, make):
    """Cosines depend on the items and on how many documents have each word, not on which passages of documents are looked at."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=24)) for _ in range(90)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(40)]
    others = [[w for w in rng.choices(vocabulary, k=400)] for _ in range(30)]

    def cosines(fill):
        rows = decontamination.find_benchmark(make([*(f"{a} {x} {b}" for a, x, b in zip(around[::2], items[:20], around[1::2], strict=True)), *(" ".join(x) for x in fill)]), bench).where("item_id is not null and common = 1").collect()
        return {r.doc_id: round(r.cosine, 5) for r in rows if r.doc_id < 20}

    found = cosines(others)
    assert len(found) == 20 and found == cosines([sorted(x) for x in others])
