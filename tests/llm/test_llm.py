"""The training-data operators on small fixtures: brute force, invariants and hard cases."""

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import encoding, leakage, mixing, near_duplicates, neighbours, packing, pairs, splitting

T0 = dt.datetime(2025, 1, 1)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# 1 ---------------------------------------------------------------------------------------------------------------


ANSWERS = "answer_id string, question string, answer string, recorded_at timestamp, refused boolean, defect string"


def judged(spark, rows):
    body = "Unless the motion was filed, the clerk must serve {} copies for the court within ten days."
    rest = [(f"x{i}", "Who serves the motion?", body.format(i) + (" [1]" if i % 3 else ""), T0, False, "z") for i in range(120)]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows] + rest, ANSWERS)
    return {r[0]: r[1] for r in pairs.defective_pairs(df).collect()}


def test_pairs_cases(spark):
    q = "How many days does the guardian have to appeal the order?"
    got = judged(
        spark,
        [
            ("empty1", q, None, T0), ("empty2", q, " ​ \n", T0), ("empty3", q, "<p></p>", T0), ("empty4", q, "N/A", T0), ("empty5", q, "[no answer]", T0),
            ("cut1", q, "The guardian must file the appeal within ten days and the", T0), ("cut2", q, 'The clerk wrote: "The guardian must file the appeal.', T0),
            ("cut3", q, "The steps are these.\n1. The clerk files the order.\n2.", T0), ("cut4", q, "The guardian may appeal within ten days. (MCR 4.", T0), ("cut5", q, "The rule holds.\n\n| step | who |\n|---|---|\n| 1 | the", T0),
            ("no1", q, "I'm sorry, but I can't help with questions about appeals.", T0), ("no2", q, "The provided sources do not contain enough information to answer. Let me know if there is something else.", T0),
            ("no3", "¿Puede el tutor apelar la orden?", "Lo siento, las reglas citadas no responden a esta pregunta.", T0),
            ("copy1", q, "Question: " + q.lower(), T0), ("copy2", q, q + " " + q, T0),
            ("lang1", q, "Le tuteur doit déposer la requête dans les dix jours après l’audience. [1]", T0), ("lang2", "¿Cuántos días tiene el tutor para apelar?", "The guardian has ten days to appeal the order after the hearing.", T0),
            ("ok1", q, "That rule does not address the order itself, but MCR 4.599 does [2].", T0), ("ok2", q, 'The posted notice reads: "El tribunal debe resolver la solicitud dentro de diez días." It binds the guardian.', T0),
            ("ok3", q, "Ten days.", T0), ("ok4", q, "The guardian has ten days.\n\nSource: MCR 9.551(C)", T0), ("ok5", None, "The guardian has ten days (MCR 8.743(A)).", T0), ("ok6", q, "¿? " + q + " In short, the guardian has ten days after the order is served on all the parties. [1][3]", T0),
            ("late", q, "N/A", T0), ("late", q, "The guardian has ten days.", T0 + dt.timedelta(1)), (None, q, None, T0),
        ],
    )
    kinds = {"empty": "empty", "cut": "truncated", "no": "refusal", "copy": "copied_question", "lang": "other_language"}
    for name in [f"empty{i}" for i in range(1, 6)] + [f"cut{i}" for i in range(1, 6)] + ["no1", "no2", "no3", "copy1", "copy2", "lang1", "lang2"]:
        assert got.get(name) == kinds[name.rstrip("0123456789")], (name, got.get(name))
    assert not {f"ok{i}" for i in range(1, 7)} & set(got) and "late" not in got and None not in got


def test_pairs_empty_and_long(spark):
    assert pairs.defective_pairs(spark.createDataFrame([], ANSWERS)).count() == 0
    long = "The clerk files the order. " * 20_000
    assert judged(spark, [("long", "Who files the order?", long, T0), ("cut", "Who files the order?", long + "The clerk", T0)]) == {"cut": "truncated"}


def test_pairs_copies_of_many_repeats():
    q = "How many days does the guardian have to appeal the order?"
    changed = q.replace("guardian", "custodian")
    assert all(pairs.is_copy(q, " ".join([q] * n)) for n in (1, 4, 5, 6, 50, 5000))
    assert pairs.is_copy(q, "\n".join(f"Question: {x}" for x in [q, changed] * 6)) and pairs.is_copy("为什么？", "为什么？" * 9)
    assert pairs.is_copy(q, "Answer: " + " ".join([q, q[:-7]] * 8))
    assert not pairs.is_copy(q, q + " The guardian must file the appeal with the clerk of the court within ten days." * 5)
    assert not pairs.is_copy(q, " ".join(sorted(q.split() * 9)))


def test_language_of_a_long_run():
    model = pairs.Language(pairs.seed_words())
    head, rest = "法院应当在开庭后十日内就申请作出决定提交答复的一方应当把副本送达另一方如果书记员没有记录命令", "судопроизводствозаявлениеходатайство" * 9
    assert len(head) > 40 and model.language_of(head) == "zh"
    assert model.language_of(head + rest) == "ru"


def test_language_model_held_out():
    m = pairs.fit_language([])
    for lang, text in (("pt", "A criança poderá assinar a certidão depois da sessão."), ("pl", "Świadek odrzuca załącznik przed rozprawą."), ("vi", "Nhân viên gửi bản dịch tại phiên họp."), ("ru", "Секретарь хранит перевод дела."), ("zh", "法院通常批准申请书。"), ("de", "Der Vormund verkündet die Verfügung nach Prüfung.")):
        assert m.language_of(text) == lang


def test_what_is_counted_decides_truncation():
    """Counts that say texts and sentences end after a mark make the same end sound, and the other way round."""

    def verdict(text, learned):
        ending = pairs.Ending(pairs.seed_counts() + pairs.count_contexts(learned))
        m, ends = pairs.Marks()([text])
        slots = pairs.contexts(m, ends)[ends - 1]
        return "truncated" if ending.sentence_ends(slots)[0] < 0.5 or ending.text_ends(slots)[0] < 10 else "sound"

    plain = ["The clerk files the order. The court hears the motion."] * 50
    assert verdict("The clerk files the order ~", plain) == "truncated" and verdict("The clerk files the order.", plain) == "sound"
    assert verdict("The clerk files the order ~", plain + ["The clerk files it ~ The court hears it ~ The party may go ~"] * 400) == "sound"
    assert verdict("Under MCR 6.", plain + ["The rule MCR 6.201 holds. See MCR 4.100."] * 50) == "truncated"
    assert verdict("The clerk files the order.", ["The v. order. file the no. of the id. number and the no. of it"] * 3000) == "truncated"


def test_declining_is_learned_without_the_phrase():
    """Phrases of a kind that no text of the sample holds are still told from answers."""
    answers = [f"The {a} must {b} the {c} within {n} days. [1]" for n, (a, b, c) in enumerate([(a, b, c) for a in ("clerk", "court", "party") for b in ("file", "serve", "sign") for c in ("order", "motion", "notice")])] * 6
    refusals = ["The sources are silent on this.", "I cannot help with that matter.", "I must decline to answer that.", "This is not covered by the rules supplied.", "As an assistant I cannot give legal advice."] * 6
    language = pairs.fit_language([])
    tokens = pairs.Tokens(language)
    model = pairs.fit_declining(tokens, [(t, False) for t in answers] + [(t, i % 4 > 0) for i, t in enumerate(refusals)])
    fresh = ["The provided material offers nothing on that point.", "I am not able to answer this.", "The passages do not say.", "Nothing in the sources covers this matter.", "I can't help with legal advice."]
    sound = ["The clerk must file the order.", "Only the party may sign the notice.", "The court must serve the motion within 10 days.", "Yes. See MCR 2.653(G)."]
    s = tokens.sentences(fresh + sound)
    said = model.refusals(s, len(fresh + sound)).tolist()
    assert sum(said[: len(fresh)]) >= len(fresh) - 1 and not any(said[len(fresh) :])


def test_pairs_learn_from_every_row(spark):
    """Sound answers in words that only rows with the highest hashes of their id hold are learned too."""
    ids = [r[0] for r in spark.range(12_000).selectExpr("concat('a', id) AS id").orderBy(F.xxhash64("id").desc()).collect()]
    sound = ["The bailiff keeps those ledgers.", "Nobody may lend such ledgers.", "Bailiffs never lend any information."]
    no = ["I cannot help with that matter.", "The sources say nothing about this."]
    long = "Unless the motion was filed, the clerk must serve {} copies for the court within ten days."
    text = lambda i: sound[i % 3] if i < 900 else no[i // 30 % 2] if i % 30 == 0 else long.format(i % 90)
    rows = [(x, "Who serves the motion?", text(i), T0, text(i) in no and i % 7 > 0, None) for i, x in enumerate(ids)]
    got = {tuple(r) for r in pairs.defective_pairs(spark.createDataFrame(rows, ANSWERS)).collect()}
    assert got == {(x, "refusal") for i, x in enumerate(ids) if text(i) in no}


def test_pairs_models_of_any_partitions(spark):
    """The models fitted over partitions are those fitted in one piece."""
    rows = [(f"The {a} must {b} the {c}{n}.", "Who files it?", r) for a in ("clerk", "court", "party") for b in ("file", "serve", "sign") for c in ("order", "motion") for n, r in (("", False), (" 3", None), (" within 2 days. 7.", True))]
    rows += [("I cannot help with that matter.", "¿Quién presenta la orden?", i % 3 > 0) for i in range(9)] + [("El tribunal debe resolver. 9.", None, True), ("I must decline to answer that. 12.", "", None), (None, "Why?", True), (" ", None, False)] * 3
    rows = rows * 8
    declining = pairs.fit_declining(pairs.Tokens(pairs.seed_language()), [(a, r) for a, _, r in rows])
    language = pairs.fit_language([x for r in rows for x in r[:2] if x])
    keys, n = pairs.context_keys([a for a, _, _ in rows])
    for parts in (1, 5):
        df = spark.createDataFrame([(q, a, r) for a, q, r in rows], "question string, answer string, refused boolean").repartition(parts)
        found = df.mapInArrow(pairs.evidence, pairs.EVIDENCE)
        one, other = pairs.language_of_all(found), pairs.declining_of_all(found)
        assert (one.table == language.table).all() and (one.row == language.row).all() and (one.prior == language.prior).all() and (other.odds == declining.odds).all()
        got = pairs.summed(found.where("kind = 'context'"), "key", ["a", "b", "c"])
        assert (got[0] == keys).all() and (got[1] == n).all()


def test_seed_keeps_its_weight():
    """More texts of the same kinds don't make short sound answers decline."""
    who = ["mediator", "court", "agency", "coordinator", "administrator", "clerk", "evaluator", "referee", "examiner", "supervisor", "magistrate", "interpreter"]
    no = ["The sources are silent on this.", "I cannot help with that matter.", "This is not covered by the rules supplied.", "I must decline to answer that; the rules given say nothing about it."]
    rows = [(f"No; the {w} decides that.", i == 0) for w in who for i in range(5)] + [(t, i % 4 > 0) for t in no for i in range(70)]
    rows += [(f"The {w} must file the order within {i} days. The rule is MCR 3.{i}.", False) for w in who for i in range(400)]
    tokens = pairs.Tokens(pairs.seed_language())
    counts, undecided = pairs.declining_counts(tokens.sentences([t for t, _ in rows]), np.array([1 if r else -1 for _, r in rows], dtype=np.int8))
    s = tokens.sentences([f"No; the {w} decides that." for w in who] + no)
    for times in (1, 20, 1000):
        model = pairs.learn_declining(counts * times, lambda m, n=times: undecided.rates(m) * n, lambda m, told, n=times: undecided.weights(m, told) * n)
        assert model.refusals(s, len(who + no)).tolist() == [False] * len(who) + [True] * len(no)


# 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_pack_histogram(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([16, 100, 512]))
    items = rng.integers(1, cap + 1, rng.integers(1, 400))
    lengths, counts = np.unique(items, return_counts=True)
    got = Counter()
    classes = packing.pack_histograms([(lengths, counts)], cap)[0]
    for content, n in classes:
        assert sum(k * v for k, v in content.items()) <= cap
        for k, v in content.items():
            got[k] += v * n
    assert got == Counter(items.tolist())
    assert sum(n for _, n in classes) <= 1.25 * math.ceil(items.sum() / cap) + 2


def test_least_squares_meets_an_exact_histogram():
    lengths, counts = np.array([100, 200, 212]), np.array([30, 30, 30])
    cols, waste = packing.combinations(lengths, 512, 8)
    x = packing.least_squares([(cols, waste, counts)])[0]
    full = [i for i, c in enumerate(cols) if sorted(c) == [0, 1, 2]]
    assert abs(x[full].sum() - 30) < 1


def test_pack_operator(spark):
    rng = random.Random(1)
    rows = [(f"g{rng.randrange(3)}", f"i{i:04d}", rng.randrange(1, 60)) for i in range(300)] + [("big", "b1", 250), ("big", "b2", 1), (None, "n1", 40), (None, "n2", None), ("z", None, 5), ("hot", "h", 0)]
    df = spark.createDataFrame(rows, "grp string, id string, length int").withColumn("container", F.lit("clash"))
    out = packing.pack(df, 100, salts=5).collect()
    assert {(r.grp, r.id) for r in out} == {(g, i) for g, i, _ in rows if i is not None}
    used = defaultdict(int)
    for r in out:
        used[r.grp, r.container] += r.length
    assert all(v <= 100 for v in used.values()) and all(r.room == 100 - used[r.grp, r.container] for r in out)
    assert sorted(r.length for r in out if r.id == "b1") == [50, 100, 100] and sum(r.part for r in out if r.id == "b1") == 6
    assert packing.pack(df.limit(0), 100).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------


def vector_frame(spark, x, ids=None):
    rows = [((ids[i] if ids else f"v{i:05d}"), [float(a) for a in v], T0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, loaded_at timestamp")


def test_similar_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64))
    x = (centres[rng.integers(0, 40, 3000)] + 0.9 * rng.standard_normal((3000, 64))).astype(np.float32)
    x[100] = x[7] * 3  # the same direction
    got = neighbours.most_similar(neighbours.usable_vectors(vector_frame(spark, x), "chunk_id", "embedding", 64, "loaded_at"), region=600, leaf=150).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    near = defaultdict(dict)
    for r in got:
        near[int(r.id[1:])][int(r.neighbour[1:])] = r.similarity
    assert len(near) == 3000 and all(len(v) == 10 for v in near.values())
    assert np.mean([len(set(top[i]) & set(near[i])) / 10 for i in range(3000)]) >= 0.9
    assert all(abs(s[i, j] - v) < 1e-4 for i, d in list(near.items())[:50] for j, v in d.items())
    assert near[7][100] == pytest.approx(1) and near[100][7] == pytest.approx(1)


def test_regions_are_bounded(spark):
    """A third of all vectors in one narrow place: every region is parted until none is much over its size."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] + 1e-3 * rng.standard_normal((2000, 64))
    reps = neighbours.usable_vectors(vector_frame(spark, x), "chunk_id", "embedding", 64)
    u = neighbours._stack([r.v for r in reps.collect()])
    for tree in neighbours.coarse_trees(reps, 6000, 3, 40, 1):
        sizes = np.bincount(tree.of(u), minlength=tree.regions)
        assert sizes.sum() == 6000 and sizes.max() <= 60 and tree.regions < 6000 / 40 * 4


def test_similar_hard_cases(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 64))
    x[:25] = x[0]  # a class of copies larger than k
    df = vector_frame(spark, x).unionByName(
        spark.createDataFrame([("nul", None, T0), ("zero", [0.0] * 64, T0), ("nan", [float("nan")] * 64, T0), ("inf", [float("inf")] + [0.0] * 63, T0), ("short", [1.0] * 3, T0), (None, [1.0] * 64, T0), ("v00059", [1.0] * 64, T0 - dt.timedelta(9))], "chunk_id string, embedding array<float>, loaded_at timestamp")
    )
    df = df.withColumn("v", F.lit("clash")).withColumn("id", F.lit(3))
    got = neighbours.most_similar(neighbours.usable_vectors(df, "chunk_id", "embedding", 64, "loaded_at")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r.neighbour)
    assert set(by) == {f"v{i:05d}" for i in range(60)} and all(len(v) == 10 and k not in v for k, v in by.items())
    first = [f"v{i:05d}" for i in range(11)]
    for i in range(25):
        me = f"v{i:05d}"
        assert sorted(by[me]) == [a for a in first if a != me][:10]
    assert neighbours.most_similar(neighbours.usable_vectors(df.limit(0), "chunk_id", "embedding", 64, "loaded_at")).count() == 0
    assert neighbours.most_similar(neighbours.usable_vectors(df.where("chunk_id = 'v00003'"), "chunk_id", "embedding", 64, "loaded_at")).count() == 0
    both = neighbours.most_similar(neighbours.usable_vectors(df.where("chunk_id IN ('v00003', 'v00030')"), "chunk_id", "embedding", 64, "loaded_at"))
    assert both.count() == 2


def test_mutual(spark):
    df = spark.createDataFrame([("a", "b", 0.97), ("b", "a", 0.97), ("a", "c", 0.99), ("c", "d", 0.9), ("d", "c", 0.9)], "id string, neighbour string, similarity double")
    assert [tuple(r)[:2] for r in neighbours.mutual(df, 0.95).collect()] == [("a", "b")]


# 4 ---------------------------------------------------------------------------------------------------------------


def test_split_levels():
    s = "The clerk files the order. "
    para = (s * 40).strip()
    assert splitting.split(para + "\r\n \t\r\n" + para, 1500, 150)[0] == "paragraph"
    assert splitting.split("\r\n".join([para, para]), 1500, 150)[0] == "line"
    assert splitting.split(para + " " + para, 1500, 150)[0] == "sentence"
    assert splitting.split("word " * 400, 1500, 150)[0] == "word"
    assert splitting.split("x" * 1600, 1500, 150)[0] == "none"
    # one CRLF is no blank line
    assert len(splitting.units("a\r\nb")["paragraph"]) == 1 and len(splitting.units("a\r\n\r\nb")["paragraph"]) == 2


@pytest.mark.parametrize("seed", range(5))
def test_split_round_trip(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "clerk. ", "\n\n", "\r\n", "longer; ", "é" * 30, "。字", " "]) for _ in range(3000))
    _, parts = splitting.split(text, 300, 40)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert all(b - max(0, a - 40 if i else a) <= 300 for i, (a, b, _) in enumerate(parts))
    assert parts[0][0] == 0 and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))


def test_split_takes_the_deepest_valley():
    one, two = "motion clerk order filing served. " * 14, "kinship visit parent child home. " * 14
    _, parts = splitting.split((one + two).strip(), 700, 50)
    assert abs(parts[0][1] - len(one)) <= 2


def test_split_keeps_a_long_unit_whole():
    first, second = "The clerk files the order. " * 15, "word " * 260
    text = first.strip() + "\n\n" + second.strip() + "\n\n" + first.strip()
    _, parts = splitting.split(text, 1500, 150)
    assert parts[0] == (0, len(first.strip()) + 2, "paragraph") and text[slice(*parts[1][:2])].strip() == second.strip()
    # of several ends before the window the last; a sentence end if there is no other
    _, parts = splitting.split("One.\n\nTwo.\n\nThree. Four.\n\n" + second + second, 1500, 150)
    assert parts[0] == (0, 26, "paragraph") and parts[1][2] == "word"
    assert splitting.split("One is here. " + second + second, 1500, 150)[1][0] == (0, 13, "sentence")


def test_split_operator(spark):
    long = "The clerk files the order. " * 100
    rows = [("a", long, ["H"], 3), ("a", long, ["H"], 3), ("b", long, None, None), ("c", "short", [], 0), ("d", None, [], 1), ("e", "", [], 1), ("f", " " * 2000, [], 1), ("g", "字" * 1501, [], 1), ("h", "字" * 1500, [], 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, heading_path array<string>, page_start int").withColumn("piece", F.lit("clash"))
    out = splitting.split_oversized(df).collect()
    assert {r.chunk_id for r in out} == {"a", "b", "f", "g"}
    a = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.piece)
    assert [r.piece for r in a] == list(range(1, a[0].n_pieces + 1)) and all(r.heading_path == ["H"] and r.page_start == 3 for r in a)
    assert all(len(r.text) <= 1500 for r in out)
    assert all(y.text.startswith(x.text[-150:]) for x, y in zip(a, a[1:]))
    assert splitting.split_oversized(df.limit(0)).count() == 0
    assert splitting.cut_levels(splitting.split_oversized(df)).count() == 4


# 6 ---------------------------------------------------------------------------------------------------------------


def brute(rows, t=0.6, k=3, least=20):
    sets = []
    for i, x in rows:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if i is not None and len(w) >= least:
            sets.append((i, frozenset(zip(*(w[j:] for j in range(k))))))
    out = set()
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i != j and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((min(i, j), max(i, j)))
    return out


def found_pairs(spark, rows, **kw):
    df = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("set", F.lit("clash")).withColumn("space", F.lit(1))
    got = near_duplicates.near_duplicate_sets(near_duplicates.texts(df, "chunk_id", "text", "s"), 0.6, **kw)
    return got, {(r.id_a, r.id_b) for r in near_duplicates.id_pairs(*got).collect()}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for i in range(60):
        base = words(rng, rng.choice([20, 30, 80, 300, 900]), 3000).split()
        rows.append((f"b{i}", " ".join(base)))
        for j in range(rng.randrange(4)):
            edited = [w if rng.random() > 0.08 else f"e{rng.randrange(10**6)}" for w in base]
            rows.append((f"b{i}c{j}", " ".join(edited[rng.randrange(5) :])))
    shared = words(rng, 40, 50)  # a passage in many records
    rows += [(f"s{i}", shared + " " + words(rng, 40, 5000)) for i in range(40)]
    rows += [("b0", rows[5][1]), ("dup1", rows[0][1].upper()), ("dup2", rows[0][1]), ("x", None), (None, rows[0][1]), ("short", "a b c"), ("empty", "")]
    _, got = found_pairs(spark, rows, block=block)
    assert got == brute(rows)


def test_near_duplicate_copies_and_groups(spark):
    rng = random.Random(3)
    one, two = words(rng, 60, 900), words(rng, 60, 900)
    near = one + " extra words here"
    rows = [(f"c{i:03d}", one) for i in range(200)] + [("n", near), ("o", two), ("p", two)]
    (sets, members), got = found_pairs(spark, rows)
    assert ("c000", "n") in got and ("o", "p") in got and len(got) == 199 + 1 + 1  # a star, not all pairs
    g = {r.id: (r.group_id, r.links) for r in near_duplicates.groups(sets, members).collect()}
    assert len(g) == 203 and {v[0] for k, v in g.items() if k[0] in "cn"} == {"c000"} and g["o"] == ("o", 0) and g["n"][1] == 1
    empty = spark.createDataFrame([], "chunk_id string, text string")
    sets, members = near_duplicates.near_duplicate_sets(near_duplicates.texts(empty, "chunk_id", "text", "s"), 0.6)
    assert sets.count() == 0 and near_duplicates.id_pairs(sets, members).count() == 0 and near_duplicates.groups(sets, members).count() == 0


def test_near_duplicate_large_classes(spark):
    rng = random.Random(9)
    standing, other = words(rng, 40), words(rng, 40)
    near = standing.rsplit(" ", 3)[0] + " but not so"
    # one class of 90 variants, a similar one of 70, one apart of byte-equal texts, and ids that are in two classes
    rows = [(f"v{i:02}", standing.upper() + "!" * i) for i in range(90)] + [(f"n{i:02}", near + "." * i) for i in range(70)] + [(f"e{i:02}", other) for i in range(80)]
    rows += [(f"v{i:02}", near) for i in range(5)] + [(f"e{i:02}", standing) for i in range(3)] + rows[:4]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = near_duplicates.near_duplicate_sets(near_duplicates.texts(df, "chunk_id", "text", "s").unionByName(near_duplicates.texts(df, "chunk_id", "text", "t")), 0.6)
    pairs = [(r.id_a, r.id_b) for r in near_duplicates.id_pairs(*got, expand=None, block=7).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows)
    # else only the byte-equal texts are a star around e00; e01 and e02 are a pair by their other text
    pairs = [(r.id_a, r.id_b) for r in near_duplicates.id_pairs(*got, block=7).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {x for x in brute(rows) if not "e00" < x[0] < x[1] < "f"} | {("e01", "e02")}


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101)]
    edges = spark.createDataFrame([("s", f"{a:03d}", f"{b:03d}") for a, b in chain] + [("s", f"{b:03d}", f"{a:03d}") for a, b in chain], "space string, u string, v string")
    label = {r.v: r.label for r in near_duplicates.components(edges).collect()}
    assert {label[f"{i:03d}"] for i in range(31)} == {"000"} and label["101"] == "100"


# 7 ---------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(7)
    gold = words(rng, 60, 5000)
    g = gold.split()
    filler = lambda n: words(rng, n, 5000)
    edited = g[5:45]
    for i in (4, 13, 22, 31):
        edited[i] = "changed"
    moved = g[:12] + ["z"] * 5 + g[30:42]
    marked = "<!-- page: 4 -->\n".join([" ".join(g[10:25]).upper() + ",\n", "**" + "**; ".join(g[25:35])])
    shuffled = g[:]
    rng.shuffle(shuffled)
    docs = [(1, filler(30) + " " + gold + " " + filler(30)), (2, filler(20) + " ".join(["", *edited, ""]) + filler(9)), (3, " ".join(moved)), (4, marked), (5, filler(90)), (6, None), (None, gold), (7, ""), (8, " ".join(g[:12])), (9, filler(30000) + " " + " ".join(g[20:45])), (10, " ".join(shuffled)), (1, filler(3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("query_id", F.lit("clash"))
    items = spark.createDataFrame([("q1", gold), ("q2", filler(40)), ("q3", None), (None, gold), ("q4", "too short"), ("q5", gold)], "query_id string, gold_text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.query_id): r for r in leakage.leaks(df, items).collect()}
    assert set(got) == {(d, q) for d in (1, 2, 4, 9) for q in ("q1", "q5")}
    assert got[1, "q1"].words == 60 and got[1, "q1"].edits == 0 and got[2, "q1"].edits in (4, 5) and 25 <= got[9, "q1"].words <= 28
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_stretch_against_brute_force():
    rng = random.Random(0)
    item = np.array([rng.randrange(1000) for _ in range(60)])
    for edits, expect in ((0, True), (2, True), (15, False)):
        doc = item.copy()
        doc[np.linspace(1, 58, edits).astype(int)] = -1
        found = leakage.stretch(item, doc, 0, 20, 1 / 8)
        assert bool(found and found[0] >= 40) == expect


# 8 ---------------------------------------------------------------------------------------------------------------


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 500, 400).astype(float)
    p = np.full(400, 0.37)
    out = mixing.flight(p, tokens, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * tokens).sum() == pytest.approx((p * tokens).sum(), abs=1e-3)
    landed = mixing.landing(out, tokens)
    assert set(landed) <= {0.0, 1.0} and abs((landed * tokens).sum() - (p * tokens).sum()) <= 1000
    assert (mixing.flight(np.full(9, 0.5), np.full(9, 3.0), rng) >= 0).all()


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, ["News", "web_pages", "web-pages ", "WEB PAGES"][min(3, i % 7)] if i % 50 else "tiny", words(rng, rng.randrange(1, 80))) for i in range(1, 900)] + [(2000, None, "x"), (2001, "other", "y"), (2002, "news", None), (2003, "news", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("times", F.lit("clash"))
    goals = [("m", "news", 1.0, 6), ("m", "web_pages", 3.0, 2), ("m", "absent", 1.0, 5), ("m", "tiny", 1.0, 2), ("n", "news", 0.5, 1), ("n", "Web Pages", 0.5, 1), ("n", "tiny", None, 3), (None, "news", 1.0, 1)]
    targets = spark.createDataFrame(goals, "mix_name string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(df, targets, block=64)
    rows = selection.collect()
    most = {(m, mixing_key(x)): n for m, x, _, n in goals if m}
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows) and all(1 <= r.times <= most[r.mix_name, r.source] for r in rows)
    s = {(r.mix_name, r.source): r for r in shares.collect()}
    assert s["m", "absent"].tokens == 0 and s["n", "tiny"].target_share == 0 and s["m", "news"].target_share == pytest.approx(1 / 6)
    assert sum(r.actual_share for k, r in s.items() if k[0] == "m") == pytest.approx(1)
    assert abs(s["n", "news"].actual_share - 0.5) < 0.02
    assert s["m", "tiny"].most_used == 2
    again = mixing.mix(df.repartition(3), targets, block=64)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    for a, b in ((df.limit(0), targets), (df, targets.limit(0))):
        assert mixing.mix(a, b)[0].count() == 0


def mixing_key(x):
    return x.lower().replace(" ", "_")


# 9 ---------------------------------------------------------------------------------------------------------------


CLEAN = ["The party’s “first” résumé — see § 3.", "A naïve façade for Ñandor’s “as filed” motion.", "Año en curso: la petición según la política.", "Le père doit déposer l’évaluation à l’échéance prévue.", "Sąd może zmienić wniosek później.", "Суд обязан подать дело по запросу.", "法院可以依申请批准申请书。", "Tòa án gửi bản dịch tại quận."]


def garble(text, codec):
    out = []
    for c in text.encode("utf-8"):
        try:
            out.append(bytes([c]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(c))
    return "".join(out)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_encoding_round_trip(spark, codec):
    rows = [(i, t) for i, t in enumerate(CLEAN * 6)] + [(1000 + i, garble(t, codec)) for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_left", F.lit("clash"))
    got = {r.doc_id: r.text for r in encoding.restore_encoding(df).collect()}
    assert set(got) == {1000 + i for i in range(len(CLEAN))}
    assert [got[1000 + i] for i in range(len(CLEAN))] == CLEAN


def test_encoding_losses_and_traps(spark):
    sound = ["NÃO FUMAR", "CHÂTEAU LOWFELL, SALLE Â-2", "Fee: £12 or €14 per copy", "Width ½″ × 3″, 20 °C", "AT&T &amp; co", "¿Qué pasa?", "naïve café — “ok”", "露天 搂抱 茅台", "", None, "plain"]
    bad = ["the child�s motion", "a r�sum� here", "the � 3 rule", "child&#226;&#8364;&#8482;s", "it was \x93quoted\x94", garble(garble(CLEAN[0], "cp1252"), "cp1252"), "the 鈥渇irst鈥? motion"]
    rows = [(i, t) for i, t in enumerate(sound)] + [(100 + i, t) for i, t in enumerate(bad)] + [(500 + i, t + " the child’s résumé § 3") for i, t in enumerate(CLEAN * 4)] + [(None, bad[0]), (100, bad[0])]
    out = encoding.restore_encoding(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in out}
    assert set(got) == {100 + i for i in range(len(bad))} and len(out) == len(bad) + 1
    assert [got[100 + i].text for i in (0, 1, 2, 3, 4, 5)] == ["the child’s motion", "a résumé here", "the § 3 rule", "child’s", "it was “quoted”", CLEAN[0]]
    assert got[106].text == "the “first” motion"
    assert encoding.restore_encoding(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [encoding.BROADCAST_CHARS, 0])
def test_encoding_single_bytes_and_no_caps(spark, monkeypatch, limit):
    """Other single-byte encodings, by frequency; tokens of any length, seen once; damaged tokens broadcast or joined."""
    monkeypatch.setattr(encoding, "BROADCAST_CHARS", limit)
    sound = ["Ñandor is naïve, a résumé", "Суд решил", "Ñandor saw the naïve façade", "Ï saw × 3 µ"] * 5 + ["Język ďábel loď", "Straße", "văn bản"]
    long = "法院应当在开庭后十日内就申请作出决定提交答复的一方应当把副本送达另一方如果书记员没有记录命令" * 3
    bad = ["Ńandor’s case is naďve", "Ñóä решил", "a rŽsumŽ of Ñandor", garble(long, "cp1252"), "the fa�ade", "Î±Î²Î³ and ðŸ˜€", "x" * 60 + "Ã©"]
    rows = [(i, t) for i, t in enumerate(sound)] + [(100 + i, t) for i, t in enumerate(bad)]
    out = {r.doc_id: r for r in encoding.restore_encoding(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {100 + i for i in range(len(bad))}
    assert [out[100 + i].text for i in range(len(bad))] == ["Ñandor’s case is naïve", "Суд решил", "a résumé of Ñandor", long, "the façade", "αβγ and 😀", "x" * 60 + "é"]
