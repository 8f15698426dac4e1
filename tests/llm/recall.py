"""Recall of the ten most similar vectors against brute force, by size of the regions: python tests/llm/recall.py DIR [REGION...].

A region of 0 is what most_similar() takes by itself; 10000, 1250 and 160 make 8, 64 and 512 regions of check_l.

The queries are the vectors of which the hash of the id is divisible by 100, searched for among all.
"""

import sys
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

if __name__ == "__main__":
    from corpusmill.llm import neighbours
    from corpusmill.session import local_session, materialise
    from corpusmill.sources.tables import table

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    vectors = materialise(neighbours.usable_vectors(table(spark, sys.argv[1], "chunks"), "chunk_id", "embedding", 64, "loaded_at"), "vectors")
    rows = vectors.collect()
    ids = np.array([r.id for r in rows], dtype=object)
    x = np.frombuffer(b"".join(r.v for r in rows), dtype=np.float32).reshape(len(rows), -1)
    asked = [i for i, name in enumerate(ids) if zlib.crc32(name.encode()) % 100 == 0]
    exact = {}
    for i in asked:
        s = x @ x[i]
        s[i] = -2
        exact[ids[i]] = s[np.argpartition(-s, 9)[:10]].min()
    for region in [int(a) or None for a in sys.argv[2:] or ("0", "10000", "1250", "160")]:
        began = time.time()
        near = defaultdict(list)
        for r in neighbours.most_similar(vectors, region=region).collect():
            if r.id in exact:
                near[r.id].append(r.similarity)
        # a neighbour no less similar than the tenth of brute force is one of the ten, whichever of equal ones it is
        hits = [sum(v >= exact[i] - 1e-5 for v in near[i]) / 10 for i in exact]
        print(f"regions of {region}: recall {np.mean(hits):.4f} of {len(hits)} queries among {len(ids)} vectors, {time.time() - began:.0f} s", flush=True)
