import numpy as np


def auc(score, label):
    order = np.argsort(score)
    s, y = np.array(score)[order], np.array(label)[order]
    rank = np.arange(1, len(s) + 1, dtype=float)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))
