"""The exchange of co-training: a view learns from the other what its own labelled documents do not show, and a round hands over what it says."""

import numpy as np

from heddle.llm import quality as Q


def planted(seed=3, labelled=400, pool=1500):
    """Metadata tell every label; the words that tell them stand in unlabelled documents only."""
    rng = np.random.default_rng(seed)
    n = labelled + pool
    bad = rng.random(n) < 0.4
    meta = np.zeros((n, 4))
    meta[np.arange(n), np.where(bad, 0, 1)] = 1
    meta[:, 2:] = rng.normal(size=(n, 2))
    shape = rng.normal(size=(n, 12))
    common, telling = np.arange(1, 60, dtype=np.uint64), np.arange(1000, 1010, dtype=np.uint64)
    words = [np.concatenate([rng.choice(common, 20, replace=False), rng.choice(telling, 3, replace=False) if bad[i] and i >= labelled else np.zeros(0, np.uint64)]) for i in range(n)]
    label = np.where(np.arange(n) < labelled, bad.astype(int), -1)
    aside = (np.arange(n) < labelled) & (np.arange(n) % 3 == 0)
    return shape, words, meta, label, aside, np.zeros(n, bool), bad


def area(score, bad):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())


def text_logits(model, shape, words):
    first = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    return model.text.logit(np.hstack([shape, Q.lexicon_features(np.concatenate(words), first, model.lexicon)]))


def test_the_text_view_learns_from_the_metadata_view():
    shape, words, meta, label, aside, toxic, bad = planted()
    pool = label < 0
    alone, together = (area(text_logits(Q.co_train(shape, words, meta, label, aside, toxic, rounds), shape, words)[pool], bad[pool]) for rounds in (0, Q.ROUNDS))
    assert alone < 0.6 and together > 0.95


def test_a_round_hands_over_the_surest_documents(monkeypatch):
    """The labels of the second view after one round, from the first view's fit and the rule in plain words."""
    shape, words, meta, label, aside, toxic, _ = planted(5)
    monkeypatch.setattr(Q, "HANDED", 40)
    fits, real = [], Q.Logistic.fit.__func__
    monkeypatch.setattr(Q.Logistic, "fit", classmethod(lambda cls, x, y, *rest, **more: fits.append((x, y, real(cls, x, y, *rest, **more))) or fits[-1][2]))
    Q.co_train(shape, words, meta, label, aside, toxic, 1)
    (_, y_text, text), (x_meta, y_meta, view), (_, after_text, _), (_, after_meta, _) = fits[:4]
    train = (label >= 0) & ~aside
    assert y_text.tolist() == y_meta.tolist() == label[train].tolist()
    p = 1 / (1 + np.exp(-view.logit(meta)))
    sure = lambda score: sorted((i for i in np.flatnonzero(label < 0) if score[i] >= Q.SURE), key=lambda i: (-score[i], i))[:40]
    want = {i: 1 for i in sure(p)} | {i: 0 for i in sure(1 - p)}
    rows = np.flatnonzero(train | np.isin(np.arange(len(label)), list(want)))
    assert len(want) == 80 and after_text.tolist() == [want.get(i, label[i]) for i in rows.tolist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    lexicon = Q.learn_lexicon([words[i] for i in np.flatnonzero(train)], label[train] == 1)
    q = 1 / (1 + np.exp(-text.logit(np.hstack([shape, Q.lexicon_features(np.concatenate(words), first, lexicon)]))))
    assert len(after_meta) == train.sum() + len(sure(q)) + len(sure(1 - q))
