"""The best games of a part of the users within a block of groups of games, added up in place by a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EPS, CELLS = 1e-9, 1 << 21  # CELLS: what a task holds at once for some of its users


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of a column of lists in one, each list's first place and its length."""
    lists = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.cumsum(n) - n, n


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n places from start on each, one range after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1 ... within each run of equal keys."""
    return np.arange(len(sorted_keys)) - np.searchsorted(sorted_keys, sorted_keys)


def best_groups(score: np.ndarray, n_gone: np.ndarray, size: np.ndarray, k: int, gone_at_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """score: users by groups in order of their first game, 0 where nothing speaks for one. Pairs of user and group that hold
    the user's k best games, and the least that the k-th score can be (-inf if there are fewer games). As many groups as k and
    the games that are gone are enough in order of score and first game: their first games come before all games of the rest."""
    m = min(score.shape[1], k + gone_at_most)
    edge = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
    user, group = np.nonzero((score >= edge[:, None]) & (score > 0))
    order = np.lexsort((group, -score[user, group], user))
    user, group = user[order], group[order]
    upto, place = np.cumsum(size[group]), _places(user)
    upto = upto - (upto - size[group])[np.arange(len(user)) - place] - n_gone[user]  # games of these groups that are left at least
    least = np.full(len(score), -np.inf)
    np.maximum.at(least, user[upto >= k], score[user, group][upto >= k])
    keep = (place < m) & (score[user, group] >= least[user])
    return user[keep], group[keep], least


def best_of_block(k: int, share: float, base: float, gone_at_most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """users: user_id, key and s (the heaviest first), gone; groups: grp, keys, size, heads. The two rounds of best_games()."""

    def run(users: pa.Table, groups: pa.Table) -> pa.Table:
        columns = ("user_id", "n_first", "n_looked_up", "appid", "score")
        if not len(users) or not len(groups):
            return pa.table([users["user_id"].slice(0, 0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))], names=columns)
        groups = groups.sort_by("grp")
        n_groups, size = len(groups), groups["size"].to_numpy()
        names, g_start, g_n = _flat(groups["keys"])
        listed = names.unique()
        g_key = pc.index_in(names, listed).to_numpy(zero_copy_only=False).astype(np.int64)
        l_group = np.repeat(np.arange(n_groups), g_n)[np.argsort(g_key, kind="stable")]
        l_n = np.bincount(g_key, minlength=len(listed))
        l_start = np.cumsum(l_n) - l_n
        heads, h_start, h_n = _flat(groups["heads"])
        appids, head = np.unique(heads.to_numpy(zero_copy_only=False), return_inverse=True)

        wanted, w_start, w_n = _flat(users["key"])
        key = pc.fill_null(pc.index_in(wanted, listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        s, of = _flat(users["s"])[0].to_numpy(zero_copy_only=False), np.repeat(np.arange(len(users)), w_n)
        upto = np.cumsum(s) - s  # of all heavier lists, those of the users before included
        total = np.bincount(of, s, len(users))
        early = total[of] - (upto - upto[w_start[of]]) > share * total[of]
        left = np.bincount(of, np.where(early, 0.0, s), len(users))
        clicked, c_start, c_n = _flat(users["gone"])
        clicked = clicked.to_numpy(zero_copy_only=False)
        c_at = np.minimum(np.searchsorted(appids, clicked), len(appids) - 1)
        c_here = appids[c_at] == clicked

        def some(a: int, b: int) -> tuple[np.ndarray, ...]:
            """Users a to b: user, game and score of the best in order; the sums of each round by user."""
            n, e, c = b - a, slice(w_start[a], w_start[b - 1] + w_n[b - 1]), slice(c_start[a], c_start[b - 1] + c_n[b - 1])
            user_of, q, x = of[e] - a, key[e], s[e]

            def cells(lists: np.ndarray) -> np.ndarray:
                return np.repeat(user_of[lists] * n_groups, l_n[q[lists]]) + l_group[_expand(l_start[q[lists]], l_n[q[lists]])]

            lists = np.flatnonzero(early[e] & (q >= 0))
            first = np.bincount(cells(lists), np.repeat(x[lists], l_n[q[lists]]), n * n_groups).reshape(n, n_groups)
            least = best_groups(first, c_n[a:b], size, k, gone_at_most)[2] - EPS
            chosen = (first > 0) & (first + left[a:b, None] >= least[:, None])
            opened = (left[a:b] >= least) & (left[a:b] > 0)
            chosen.reshape(-1)[cells(np.flatnonzero(~early[e] & (q >= 0) & opened[user_of]))] = True

            weight = np.zeros((n, len(listed)))
            weight[user_of[q >= 0], q[q >= 0]] = x[q >= 0]
            user, group = np.nonzero(chosen)
            own = weight[np.repeat(user, g_n[group]), g_key[_expand(g_start[group], g_n[group])]]
            score = np.zeros((n, n_groups))
            score[user, group] = np.round(base + np.bincount(np.repeat(np.arange(len(user)), g_n[group]), own, len(user)), 12)

            user, group, _ = best_groups(score, c_n[a:b], size, k, gone_at_most)
            value, game = np.repeat(score[user, group], h_n[group]), head[_expand(h_start[group], h_n[group])]
            user = np.repeat(user, h_n[group])
            gone = (np.repeat(np.arange(n), c_n[a:b]) * len(appids) + c_at[c])[c_here[c]]
            stays = np.flatnonzero(~np.isin(user * len(appids) + game, gone))
            order = stays[np.lexsort((game[stays], -value[stays], user[stays]))]
            order = order[_places(user[order]) < k]
            return user[order] + a, appids[game[order]], value[order], (first > 0).sum(axis=1), chosen.sum(axis=1)

        step = max(1, CELLS // (n_groups + len(listed) + 2 * len(g_key) + min(n_groups, k + gone_at_most) * (k + gone_at_most)))
        found = [some(a, min(a + step, len(users))) for a in range(0, len(users), step)]
        user, appid, score, n_first, n_looked_up = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(user, minlength=len(users)))]).astype(np.int32))
        best = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (appid, score)]
        return pa.table([users["user_id"], pa.array(n_first), pa.array(n_looked_up), *best], names=columns).filter(pa.array(n_first + n_looked_up > 0))

    return run
