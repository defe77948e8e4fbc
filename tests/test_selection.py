"""Visibility, empty directories, roll-up and toggles against a recursive tree model."""

import random

import pytest

from corpuspack.operators import selection as S
from corpuspack.operators.ordering import sibling_rank, tree_order
from models import any_selected, build_tree, toggle_node, walk

G_NODES = [
    ("b", True), ("b/x.py", False), ("B2", True), ("B2/y.py", False), ("a.py", False), ("B.py", False),
    ("b.py", False), ("empty", True), ("onlyhidden", True), ("onlyhidden/.h", False), (".dot", True),
    (".dot/z.py", False), ("__pycache__", True), ("__pycache__/c.pyc", False), ("src10", True),
    ("src10/fr", True), ("src10/fr/k.py", False), ("src10/de", True), ("src10/de/Test_q.py", False),
    ("src10/de/m.py", False),
]
HIDE = ["__pycache__", "Test_*", "src1[0-3]/fr/"]


def _nodes(spark, entries):
    return spark.createDataFrame(entries, "path string, is_dir boolean")


def _paths(df):
    return sorted(r.path for r in df.collect())


def test_visible_and_empty_dirs(spark):
    root = build_tree(G_NODES, HIDE)
    vis = S.visible_nodes(_nodes(spark, G_NODES), HIDE)
    assert _paths(vis) == sorted(n.path for n in walk(root))
    expect_empty = sorted(n.path for n in walk(root) if n.is_dir and not n.children)
    assert _paths(S.empty_dirs(vis)) == expect_empty == ["empty", "onlyhidden"]


def test_tree_order_is_depth_first(spark):
    root = build_tree(G_NODES, HIDE)
    vis = S.visible_nodes(_nodes(spark, G_NODES), HIDE)
    got = [r.path for r in tree_order(vis).orderBy("okey").collect()]
    assert got == [n.path for n in walk(root)]


def test_sibling_rank(spark):
    root = build_tree(G_NODES, HIDE)
    vis = S.visible_nodes(_nodes(spark, G_NODES), HIDE)
    got = {r.path: r.sibling_rank for r in sibling_rank(vis).collect()}
    expect = {}
    for n in [root, *walk(root)]:
        for i, c in enumerate(n.children):
            expect[c.path] = i + 1
    assert got == expect


def _random_tree(rng, n=60):
    entries, dirs = [], [""]
    for i in range(n):
        parent = rng.choice(dirs)
        name = rng.choice(["a", "B", "b", "c", ".h", "Test_x", "__pycache__", "src11", "fr", "d"]) + str(i % 7)
        if rng.random() < 0.15:
            name = rng.choice([".h", "fr", "src11", "__pycache__", "Test_1"])
        path = f"{parent}/{name}" if parent else name
        if any(p == path for p, _ in entries):
            continue
        is_dir = rng.random() < 0.35
        entries.append((path, is_dir))
        if is_dir:
            dirs.append(path)
    return entries


@pytest.mark.parametrize("seed", range(6))
def test_rollup_and_toggle_equal_model(spark, seed):
    rng = random.Random(seed)
    entries = _random_tree(rng)
    root = build_tree(entries, HIDE)
    nodes = list(walk(root))
    leaves = [n.path for n in nodes if not n.is_dir or not n.children]
    sel = set(rng.sample(leaves, k=len(leaves) // 3)) if leaves else set()
    vis = S.visible_nodes(_nodes(spark, entries), HIDE)
    sdf = spark.createDataFrame([(p,) for p in sorted(sel)] or [("__none__",)], "path string")
    if not sel:
        sdf = sdf.where("false")
    roll = {r.path: r.any_selected for r in S.dir_rollup(vis, sdf).collect()}
    assert roll == {n.path: any_selected(n, sel) for n in nodes if n.is_dir}
    # disjoint targets: pick nodes, drop any inside an earlier pick
    picks = []
    for n in rng.sample(nodes, k=min(6, len(nodes))):
        if not any(n.path == p.path or n.path.startswith(p.path + "/") or p.path.startswith(n.path + "/")
                   for p in picks):
            picks.append(n)
    expect = set(sel)
    for n in picks:
        toggle_node(n, expect)
    tdf = spark.createDataFrame([(n.path,) for n in picks] or [("__none__",)], "path string")
    got = _paths(S.toggle(sdf, tdf, vis))
    assert got == sorted(expect)


def test_overlapping_targets_rejected(spark):
    vis = S.visible_nodes(_nodes(spark, G_NODES), HIDE)
    sel = spark.createDataFrame([("b/x.py",)], "path string")
    t = spark.createDataFrame([("b",), ("b/x.py",)], "path string")
    with pytest.raises(Exception, match="toggle targets overlap"):
        S.toggle(sel, t, vis).collect()


def test_select_glob_all_refresh(spark):
    files = spark.createDataFrame([("a.py",), ("b/x.py",), ("c.md",)], "path string")
    assert _paths(S.select_glob(files, [])) == []
    assert _paths(S.select_glob(files, ["*.py"])) == ["a.py", "b/x.py"]
    sel = spark.createDataFrame([("empty",), ("a.py",), ("gone.py",)], "path string")
    assert _paths(S.select_all(sel, files)) == ["a.py", "b/x.py", "c.md", "empty", "gone.py"]
    assert _paths(S.refresh_selection(sel, files)) == ["a.py"]
    assert _paths(S.deselect_all(sel)) == []


def test_tree_key_order_equals_tuple_order(spark):
    rng = random.Random(17)
    alphabet = list("aAbB_-. 0Zzéɛ日本ÄäÖø~")
    paths = set()
    while len(paths) < 400:
        depth = rng.randint(1, 4)
        paths.add("/".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(depth)))
    rows = [(p, rng.random() < 0.3) for p in sorted(paths)]
    df = spark.createDataFrame(rows, "path string, is_dir boolean")
    got = [r.path for r in tree_order(df).orderBy("okey").collect()]

    def key(row):
        p, d = row
        parts = p.split("/")
        return [(i == len(parts) - 1 and not d, c.lower(), c) for i, c in enumerate(parts)]

    assert got == [p for p, _ in sorted(rows, key=key)]


def test_toggles_in_order_equal_one_by_one(spark):
    rng = random.Random(7)
    for trial in range(4):
        nodes = {}
        for _ in range(60):
            parts = [rng.choice("abc") + rng.choice(["", "é", "-", "0"]) for _ in range(rng.randint(1, 5))]
            for k in range(1, len(parts)):
                nodes["/".join(parts[:k])] = True
            nodes.setdefault("/".join(parts), rng.random() < 0.2)
        nodes = {p: d or any(q.startswith(p + "/") for q in nodes) for p, d in nodes.items()}
        leaves = {p for p, d in nodes.items() if not d or not any(q.startswith(p + "/") for q in nodes)}
        state = set(rng.sample(sorted(leaves), 10)) | {"not/there"}
        if trial == 1:
            state.add(next(p for p in sorted(nodes) if p not in leaves))  # a selected folder that has entries
        steps = [(rng.randrange(40), rng.choice(sorted(nodes) + ["none"])) for _ in range(50)]
        visible = _nodes(spark, sorted(nodes.items()))
        selection = spark.createDataFrame([(p,) for p in sorted(state)], "path string")
        toggles = spark.createDataFrame(steps, "seq int, path string")
        got = _paths(S.toggle_sequence(selection, toggles, visible))
        for _, p in sorted(steps):
            if p not in nodes:
                continue
            below = {q for q in nodes if q == p or q.startswith(p + "/")}
            if state & below:
                state -= below & leaves
            else:
                state |= below & leaves
        assert got == sorted(state), trial
    assert _paths(S.toggle_sequence(selection, toggles.limit(0), visible)) == _paths(selection)
