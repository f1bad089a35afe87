"""Scores, detection curves and hierarchies of whole tables against plain definitions."""

import json
import math
import re
from functools import cache

import numpy as np
import pytest

from millrace.functions import kernels
from millrace.plans import base, catalog

#: Words near a letter that mark it as the chosen one.
WORDS = "答案 选择 正确 是 对 answer correct choose select right 认为 应该 觉得 think believe should".split()


def got(spark, small, name):
    return catalog.queries()[name](spark, small).toPandas()


@pytest.fixture(scope="module")
def completions(spark, small):
    return base.completions(spark, small).toPandas()


@pytest.fixture(scope="module")
def boxes(spark, small):
    return base.boxes(spark, small).toPandas().astype({"score": float}).sort_values(["image_id", "ord"])


@cache
def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def answers(text, across=True):
    return re.findall("<answer>(.*?)</answer>", text, re.DOTALL if across else 0)


def last(text):
    return (answers(text) or [text])[-1].strip()


def first(text, across=True):
    return (answers(text, across) or [text])[0].strip()


def part(text):
    return " ".join(last(text).lower().split())


def clean(text):
    out = (answers(text) or [text])[-1]
    for end in "\n\r":
        out = "".join(("" if i and out[i - 1].isspace() else " ") if c == end else c for i, c in enumerate(out))
    return out.strip().rstrip(".").lower()


def choice(text):
    t = re.sub(r"\s+", " ", text.upper())
    best = None
    for x in dict.fromkeys(c for i, c in enumerate(t) if "A" <= c <= "Z" and not (i and "A" <= t[i - 1] <= "Z") and (i + 1 == len(t) or t[i + 1] in ".,?!:;")):
        at = t.find(x)
        score = sum(w.upper() in t[max(0, at - 20) : at + 20] for w in WORDS) + 2 * (at > 0.7 * len(t)) + (at < len(t) - 1 and t[at + 1] in "。.!！,，")
        if best is None or score > best[0]:
            best = (score, x)
    return best and best[1]


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def numeric(said, truth):
    a, b = number(clean(said).strip()), number(clean(truth).strip())
    return None if a is None or b is None else float(a == b)


def default(content, solution):
    said, truth = last(content), first(solution, False)
    near = lambda: ratio(clean(said), clean(truth))
    if said == truth:
        return 1.0
    if re.search(r"\d", truth):
        exact = numeric(said, truth)
        return near() if exact is None else exact
    if choice(truth):
        return float(choice(said) == choice(truth))
    return near()


def mcq(content, solution):
    said, truth = choice(first(content)), choice(first(solution, False))
    return float(said == (truth or first(solution, False))) if said else 0.0


def identity(content, solution):
    p, g = part(content), part(solution)
    if not p or not g or p == g:
        return float(bool(p) and p == g)
    pc, gc = (x.split()[0].rstrip(".:,") for x in (p, g))
    return 0.9 if pc == gc else max(ratio(p, g), 0.8 * (pc in g or gc in p))


def other(content, solution):
    p, g = part(content), part(solution)
    return ratio(p, g) if p and g else 0.0


def test_fuzzy_scores(spark, small, completions):
    mine = got(spark, small, "r6_r9_r10_r12_fuzzy").set_index("id")
    yes_no = lambda t, across: (re.findall("yes|no", first(t.lower(), across)) or [""])[0]
    for r in completions.itertuples():
        m = mine.loc[r.id]
        want = {"default_accuracy": default(r.content, r.solution), "identity": identity(r.content, r.solution), "other": other(r.content, r.solution), "ratio": ratio(r.content, r.solution)}
        want["accuracy"] = {"all_match": lambda r: float(clean(r.content) == clean(r.solution)), "yes_no": lambda r: float(yes_no(r.content, True) == yes_no(r.solution, False)), "mcq": lambda r: mcq(r.content, r.solution)}.get(r.method, lambda r: default(r.content, r.solution))(r)
        for k, v in want.items():
            assert m[k] == pytest.approx(v), (k, r.content, r.solution)


def test_choices(spark, small, completions):
    mine = got(spark, small, "t21_r4_choice").set_index("id")
    for r in completions.itertuples():
        assert (mine.loc[r.id].choice or None) == choice(r.content) and mine.loc[r.id].mcq == mcq(r.content, r.solution), r.content
    assert mine.choice.nunique() > 1


def test_scores_by_type(spark, small, completions):
    mine = got(spark, small, "r14_typed_accuracy").set_index("id").accuracy
    count = lambda t: int(m[0]) if (m := re.search(r"\d+", t)) else None
    for r in completions[completions.qa_type != "part_count"].itertuples():
        assert mine[r.id] == pytest.approx((other if r.qa_type == "other" else identity)(r.content, r.solution)), (r.content, r.solution)
    counted = [r for r in completions[completions.qa_type == "part_count"].itertuples() if count(part(r.content)) is not None]
    assert counted
    for r in counted:
        assert mine[r.id] == pytest.approx(max(0.0, 1 - 0.2 * abs(count(part(r.content)) - count(part(r.solution)))))


def overlap(a, b, crowd=False):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    mine, theirs = ((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))
    union = mine if crowd else mine + theirs - both
    return both / union if union > 0 else 0.0


def curves(images, area=(0, 1e10), most=100):
    """AP of each threshold and the mean of the last recalls, from images of (detections [(score, box)], truths [(box, crowd)])."""
    inside = lambda b: area[0] <= (b[2] - b[0]) * (b[3] - b[1]) <= area[1]
    total = sum(not crowd and inside(box) for _, truths in images for box, crowd in truths)
    if not total:
        return None
    aps, recalls = [], []
    for step in range(50, 100, 5):
        hits = []
        for found, truths in images:
            taken = set()
            for score, box in sorted(found, key=lambda d: -d[0])[:most]:
                free = [(overlap(box, t, crowd), g) for g, (t, crowd) in enumerate(truths) if g not in taken or crowd]
                free = [(o, g) for o, g in free if o >= step / 100 - 1e-12]
                ignored = lambda g: truths[g][1] or not inside(truths[g][0])  # noqa: E731, B023
                pick = max([f for f in free if not ignored(f[1])] or free, default=None)
                if pick:
                    taken.add(pick[1])
                    if not ignored(pick[1]):
                        hits.append((score, True))
                elif inside(box):
                    hits.append((score, False))
        hits.sort(key=lambda h: -h[0])
        right = np.cumsum([h for _, h in hits]) if hits else np.zeros(0)
        precision, recall = right / np.arange(1, len(hits) + 1), right / total
        best = np.maximum.accumulate(precision[::-1])[::-1]
        at = np.searchsorted(recall, np.linspace(0, 1, 101))
        aps.append(np.append(best, 0.0)[at].mean())
        recalls.append(recall[-1] if len(recall) else 0.0)
    return aps, float(np.mean(recalls))


def sides(rows):
    """Detections and truths of an image; lines of one number stand in the order of their corners and sizes."""
    placed = lambda names: sorted((r.ord, x, y, x2 - x, y2 - y, r.score, (x, y, x2, y2)) for r in rows.itertuples() for x, y, x2, y2 in [[getattr(r, n) for n in names]])
    return [(d[5], d[6]) for d in placed(("x1", "y1", "x2", "y2"))], [(d[6], d[0] == 7) for d in placed(("gx1", "gy1", "gx2", "gy2"))]


def test_detection_curves(spark, small, boxes):
    mine = got(spark, small, "g7_detection_metrics").set_index(["category", "area", "most"])
    images = {c: [sides(one) for _, one in rows.groupby("image_id")] for c, rows in boxes.groupby("label")}
    assert {k[0] for k in mine.index} == set(images) and len(mine) == 12 * len(images)
    for (category, area, most), m in mine.iterrows():
        want = curves(images[category], kernels.AREAS[area], most)
        aps, ar = want or ([-1.0] * 10, -1.0)
        assert m[["ap", "ap50", "ap75", "ar"]].tolist() == pytest.approx([np.mean(aps), aps[0], aps[5], ar], abs=1e-4), (category, area, most)


def test_detection_scores(spark, small, boxes):
    mine = got(spark, small, "r19_r20_r21_detection").set_index("image_id")
    assert set(mine.index) == set(boxes.image_id)
    # Lines of one number stand in the order of their JSON.
    listed = lambda rows, names: [(json.loads(j)["bbox_2d"], json.loads(j)["label"]) for _, j in sorted((r.ord, json.dumps({"bbox_2d": [getattr(r, n) for n in names], "label": r.label}, separators=(",", ":"))) for r in rows.itertuples())]
    for image, rows in boxes.groupby("image_id"):
        predicted, real = listed(rows, ("x1", "y1", "x2", "y2")), listed(rows, ("gx1", "gy1", "gx2", "gy2"))
        each = [curves([([(1.0, b) for b, x in predicted if x == label], [(b, False) for b, x in real if x == label])])[0] for label in sorted(set(rows.label))]
        ap, ap50 = float(np.mean(each)), float(np.mean([e[0] for e in each]))
        found, truths = [b for b, _ in predicted], [b for b, _ in real]
        wide = lambda a, b: min(a[2], b[2]) - max(a[0], b[0]) > 1 and min(a[3], b[3]) - max(a[1], b[1]) > 1
        pairs = sorted((-overlap(p, t), i, j) for i, p in enumerate(found) for j, t in enumerate(truths) if wide(p, t))
        place, left, right = 0.0, set(), set()
        for o, i, j in pairs:
            if -o >= 0.5 and i not in left and j not in right:
                left.add(i)
                right.add(j)
                place -= o * (predicted[i][1] == real[j][1])
        want = 0.7 * place / len(truths) + 0.3 * len(left) / len(truths)
        assert mine.loc[image, ["map", "ap50", "od_length", "weighted"]].tolist() == pytest.approx([ap, ap50, ap, want], abs=1e-5), image


def groups(labels):
    return {frozenset(np.flatnonzero(labels == x).tolist()) for x in set(labels.tolist())}


def plain_hierarchy(features, xyz, k, cuts):
    """Each level's clusters; the nearest two clusters that an edge joins are merged until none is left, without any shortcut."""
    n = len(xyz)
    unit = features / np.linalg.norm(features, axis=1, keepdims=True)
    edges = {(i, j) for i in range(n) for _, j in sorted((float(((xyz[i] - xyz[j]) ** 2).sum()), j) for j in range(n) if j != i)[:k]}
    near = {i: {j for e in edges if i in e for j in e if j != i} for i in range(n)}
    live, far = [frozenset([i]) for i in range(n)], {frozenset([i]): 0.0 for i in range(n)}
    parents = {}
    while True:
        cost = lambda a, b: math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * float(np.linalg.norm(unit[list(a)].mean(axis=0) - unit[list(b)].mean(axis=0)))
        reach = {a: set().union(*(near[i] for i in a)) for a in live}
        options = [(cost(a, b), x, y) for x, a in enumerate(live) for y, b in enumerate(live[:x]) if reach[a] & b]
        if not options:
            break
        d, x, y = min(options)
        a, b = live[x], live[y]
        live = [c for c in live if c not in (a, b)] + [a | b]
        far[a | b] = max(d, far[a], far[b])
        parents[a | b] = (a, b)
    top = max(far.values())

    def cut(c, limit):
        return [c] if far[c] <= limit else [x for side in parents[c] for x in cut(side, limit)]

    return [{c for root in live for c in cut(root, top * max(1 - x, 1e-4))} for x in cuts]


@pytest.mark.parametrize("seed", range(12))
def test_hierarchy_is_that_of_the_nearest_clusters(seed):
    rng = np.random.default_rng(seed)
    # Two clouds far apart, one with features that spread more than the other's.
    xyz = np.concatenate([rng.normal(size=(14, 3)), rng.normal(size=(10, 3)) + 50])
    features = np.concatenate([rng.normal(size=(14, 4)), [[9.0, 0, 0, 0]] + 0.3 * rng.normal(size=(10, 4))])
    cuts = [0.0, 0.3, 0.6, 0.9, 1.0]
    labels = kernels.hierarchy(features, xyz, 3, cuts)
    assert set(labels[0]) == {0}
    for mine, want in zip(labels[1:], plain_hierarchy(features, xyz, 3, cuts), strict=True):
        assert groups(mine) == want


def test_hierarchies_of_a_table(spark, small):
    mine = got(spark, small, "g6_ward_hierarchy")
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    for label, one in list(rows.groupby("label"))[:3]:
        x = np.stack(one.embedding.to_numpy()).astype(float)
        levels = [mine[(mine.object_id == label) & (mine.level == k)].sort_values("point_id").cluster_id.to_numpy() for k in (0, 1, 2)]
        assert set(levels[0]) == {0}
        for got_, want in zip(levels[1:], plain_hierarchy(x, x[:, :3], 4, [0.3, 0.6]), strict=True):
            assert groups(got_) == want
