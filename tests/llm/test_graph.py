import random

from quire.llm.graph import components
from quire.llm.workspace import Workspace, shared_folder


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def run(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    rows = components(Workspace(spark), frame).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_chains_stars_and_rings(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 200)]
    names = rng.sample(range(1000, 2000), 80)
    shuffled = list(zip(names, names[1:]))
    star = [(5000, k) for k in range(5001, 5200)]
    ring = [(k, k + 1) for k in range(7000, 7020)] + [(7020, 7000), (7001, 7000)]
    noise = [(rng.randrange(9000, 9300), rng.randrange(9000, 9300)) for _ in range(150)]
    edges = chain + shuffled + star + ring + noise
    edges = [e for e in edges if e[0] != e[1]]
    assert run(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert run(spark, []) == {} and run(spark, [(3, 3)]) == {}


def test_tables_are_dropped_and_kept(spark):
    work = Workspace(spark)
    assert work.folder.startswith(shared_folder(spark).rstrip("/"))
    a, b, c = (work.table(spark.range(k)) for k in (1, 2, 3))
    work.drop(a)
    work.keep(b)
    work.clear()
    assert b.count() == 2
    paths = {p.split("/")[-1] for p in work.paths.values()}
    assert paths == set()
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(work.folder)
    left = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    assert left == ["2"]
