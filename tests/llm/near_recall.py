"""Recall of operator 4 against an exact search: python tests/llm/near_recall.py /root/testdata/sf0.1

Every pair of sets with a similarity of 0.8 shares one of the rarest fifth of either's shingles, so the search looks no further; each
pair it finds is compared on full sets. This is no test, as it takes minutes; its figures are in the README.
"""

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ravenna.llm import near_dedup, queries  # noqa: E402
from ravenna.session import get_session  # noqa: E402


def exact_components(texts: dict, size: int, percent: int) -> tuple[dict, int]:
    names: dict = {}
    sets = {i: {names.setdefault(x, len(names)) for x in near_dedup.shingles(near_dedup.words_of(t), size)} for i, t in texts.items()}
    often = Counter(x for s in sets.values() for x in s)
    holders, root, links = defaultdict(list), {i: i for i in texts}, 0

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sorted(sets.items()):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]
        for j in {j for x in rare for j in holders[x]}:
            if near_dedup.linked(s, sets[j], percent):
                links += 1
                a, b = sorted((of(i), of(j)))
                root[b] = a
        for x in rare:
            holders[x].append(i)
    return {i: of(i) for i in texts}, links


if __name__ == "__main__":
    spark = get_session("local[4]", "recall", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sys.argv[1]}/documents.parquet").select("doc_id", "text").collect()}
    want, links = exact_components(texts, 2, 80)
    got = {r.doc_id: r for r in queries.op4_minmax_near_dedup(spark, sys.argv[1]).collect()}
    grouped = [i for i, c in want.items() if i != c]
    print(len(texts), "documents,", links, "links;", sum(got[i].component_id == c for i, c in want.items()), "components agree; of", len(grouped), "rows that aren't their component's first", sum(got[i].component_id == want[i] for i in grouped), "agree")
    print("n_shingles that differ:", sum(got[i].n_shingles != len(near_dedup.shingles(near_dedup.words_of(t), 2)) for i, t in texts.items()))
    spark.stop()
