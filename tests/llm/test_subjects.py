import random

from sheafline.llm import subjects as S

WORDS = {"law": "statute verdict tribunal clause plaintiff barrister appeal lease".split(), "music": "melody chord quartet oboe cello choir fugue ballad".split(), "sport": "striker referee league goalkeeper umpire sprint regatta wicket".split()}
SAYINGS = ["nothing else was found when the drawer was emptied", "please read both sections together", "we met again some days afterwards", "the older copy was kept in the folder"]


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        main = rng.choice(list(WORDS))
        second = rng.choice([s for s in WORDS if s != main]) if rng.random() < 0.2 else None
        sents, about = [], {}
        for _ in range(rng.randrange(4, 10)):
            if rng.random() < 0.3:
                sents.append(rng.choice(SAYINGS))
                continue
            s = second if second and rng.random() < 0.4 else main
            about[s] = about.get(s, 0) + 1
            a, b = rng.sample(WORDS[s], 2)
            sents.append(f"the {a} came before the {b} as everybody knew")
        truth[i] = {s for s, k in about.items() if k >= 0.25 * sum(about.values())}
        docs.append((i, "# Title Words\n\n" + ". ".join(x.capitalize() for x in sents) + ".\n\n```python\nchoir = 1\n```", "en", f"src{i % 7}"))
        if i % 6 == 0 and about:
            labels += [(i, s) for s in (truth[i] if rng.random() > 0.05 else {"law"})]
    return docs, labels, truth


def areas(spark):
    return spark.createDataFrame([(s, f"Texts about {s}: {w[0]}, {w[1]} and the like.") for s, w in WORDS.items()], "subject string, description string")


def test_held_out(spark):
    docs, labels, truth = corpus()
    extra = [(9001, None, None, None), (9002, " ", "en", "x"), (9003, "Nothing else was found when the drawer was emptied.", None, None)]
    df = spark.createDataFrame([*docs, *extra], "doc_id long, text string, lang string, source string").selectExpr("*", "'z' AS subject")
    lab = spark.createDataFrame([*labels, (1, "unknown"), (None, "law")], "doc_id long, subject string")
    shares = S.subject_shares(df, areas(spark), lab)
    got = {}
    for r in S.subjects_of(shares).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    unlabelled = [i for i in truth if i % 6]
    assert sum(got.get(i, set()) == truth[i] for i in unlabelled) >= 0.97 * len(unlabelled)
    assert not {9001, 9002, 9003} & set(got)
    assert abs(sum(r.share for r in S.composition(shares).collect()) - 1) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    assert S.subject_shares(df.limit(0), areas(spark), lab).count() == 0
    assert S.subject_shares(df, areas(spark).limit(0), lab).count() == 0


def test_sentences():
    body, heads, links = S.sentences("---\ntitle: A B\nsource: https://x.test/y\n---\n\nOne is\nwrapped. Two.\n\n# Head\n\n- item one\n- item two\n\n```\ncode\n```\n**ann** · 2026\nThree.")
    assert [s for s in body if "code" in s or "Head" in s] == [] and "One is wrapped." in body and "- item one" in body and heads == [" A B", "Head"] and links == ["https://x.test/y"]


def test_label_model_learns_accuracies():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 5000)
    votes = np.stack([np.where(rng.random(5000) < a, y, rng.integers(0, 4, 5000)) for a in (0.9, 0.6, 0.3)], axis=1)
    m = S.LabelModel(4, 3).fit(votes, np.ones(5000))
    assert m.acc[0].mean() > m.acc[1].mean() > m.acc[2].mean()
    assert (m.posterior(votes).argmax(axis=1) == y).mean() > 0.88
