"""A log of changes: every order and splitting of it makes the same table."""

import random

import pytest

from seasonframe.operators.change_table import ChangeTable

ROWS = "id long, owner int, name string, size int"
LOG = "id long, owner int, actor int, name string, size int, seq long, deleted boolean, source int"


def start(spark, folder, **names):
    rows = [(k, k % 3, f"n{k}", k * 10) for k in range(1, 21)] + [(None, 1, "keyless", 0)]
    return ChangeTable.create(spark.createDataFrame(rows, ROWS), str(folder), guard="source", parts=4, **names)


def made_log(n=160, seed=2):
    rng = random.Random(seed)
    log = []
    for seq in range(1, n):
        key = rng.choice([None, *range(1, 24)])
        actor = rng.randrange(3) if key is None or rng.random() < 0.3 else key % 3
        log.append((key, rng.choice([actor, actor, actor, 9]), actor, rng.choice([None, f"s{seq}"]), rng.choice([None, seq]), seq, rng.random() < 0.06, 1 if rng.random() < 0.05 else None))
    return log


def in_sequence(log):
    """The table after the changes, one after the other."""
    rows = {k: [k % 3, f"n{k}", k * 10] for k in range(1, 21)}
    new = []
    for key, owner, actor, name, size, _, deleted, source in sorted(log, key=lambda c: c[5]):
        if owner != actor or source is not None:
            continue
        if key is None:
            if not deleted:
                new.append([owner, name, size])
        elif key in rows and rows[key][0] == actor:
            if deleted:
                del rows[key]
            else:
                rows[key] = [actor, rows[key][1] if name is None else name, rows[key][2] if size is None else size]
    return sorted([(k, *v) for k, v in rows.items()] + [(21 + k, *v) for k, v in enumerate(new)]) + [(None, 1, "keyless", 0)]


def rows_of(table):
    found = [tuple(r) for r in table.read().select("id", "owner", "name", "size").collect()]
    return sorted((r for r in found if r[0] is not None)) + [r for r in found if r[0] is None]


@pytest.mark.parametrize("portions, seed", [(1, 0), (3, 1), (6, 2)])
def test_any_order_and_splitting(spark, tmp_path, portions, seed):
    log = made_log()
    mixed = log + log[::9]  # some come twice
    random.Random(seed).shuffle(mixed)
    table = start(spark, tmp_path / "t")
    counts = [table.apply(spark.createDataFrame(mixed[k::portions], LOG)) for k in range(portions)]
    assert rows_of(table) == in_sequence(log)
    again = ChangeTable(spark, str(tmp_path / "t"))
    assert again.apply(spark.createDataFrame(log, LOG))["applied"] == 0 and again.version == table.version
    assert rows_of(again) == in_sequence(log)
    assert sum(c["rejected"] for c in counts) > 0
    keys = sorted(r[0] for r in rows_of(table)[:-1])
    assert [k for k in keys if k > 20] == list(range(21, 21 + len([k for k in keys if k > 20])))


def test_late_and_repeated_changes(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    newer, older = (1, 1, 1, "new", None, 5, False, None), (1, 1, 1, "old", 77, 1, False, None)
    assert table.apply(spark.createDataFrame([newer], LOG)) == {"applied": 1, "stale": 0, "rejected": 0}
    # the name is older, the size is news
    assert table.apply(spark.createDataFrame([older], LOG)) == {"applied": 1, "stale": 0, "rejected": 0}
    assert (1, 1, "new", 77) in rows_of(table)
    version = table.version
    assert table.apply(spark.createDataFrame([older, newer, (1, 1, 1, "older", None, 3, False, None)], LOG)) == {"applied": 0, "stale": 3, "rejected": 0}
    assert table.version == version
    # a deletion is final, whatever comes after or before it
    assert table.apply(spark.createDataFrame([(1, 1, 1, None, None, 4, True, None)], LOG))["applied"] == 1
    assert table.apply(spark.createDataFrame([(1, 1, 1, "back", None, 9, False, None)], LOG)) == {"applied": 0, "stale": 1, "rejected": 0}
    assert all(r[0] != 1 for r in rows_of(table))
    refused = [(2, 1, 1, "theft", None, 6, False, None), (99, 1, 1, "nobody", None, 7, False, None), (3, None, 0, "x", None, 8, False, None), (3, 0, 0, "x", None, 8, False, 1)]
    assert table.apply(spark.createDataFrame(refused, LOG)) == {"applied": 0, "stale": 0, "rejected": 4}
    assert spark.read.parquet(f"{tmp_path}/t/rejected").count() == 4


def test_only_touched_parts_are_written(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    before = table.held()
    table.apply(spark.createDataFrame([(4, 1, 1, "touched", None, 1, False, None)], LOG))
    after = table.held()
    assert sum(before[p] != after[p] for p in before) == 1
    table.apply(spark.createDataFrame([(4, 1, 1, "again", None, 2, False, None)], LOG))
    table.clear(keep=1)
    assert rows_of(table) == sorted([(k, k % 3, "again" if k == 4 else f"n{k}", k * 10) for k in range(1, 21)]) + [(None, 1, "keyless", 0)]
    folders = {p.name for p in (tmp_path / "t" / "data").iterdir() if p.name.startswith("version=")}
    assert folders == {f"version={v}" for v in table.held().values()}
    assert len(list((tmp_path / "t" / "versions").glob("number=*"))) == 1


def test_sealed_keys_last(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    insert = lambda seq, name: (None, 2, 2, name, None, seq, False, None)
    table.apply(spark.createDataFrame([insert(9, "late"), insert(4, "early")], LOG))
    named = lambda: {r[2]: r[0] for r in rows_of(table) if r[0] and r[0] > 20}
    assert named() == {"early": 21, "late": 22}
    assert table.apply(spark.createDataFrame([(21, 2, 2, "no", None, 10, False, None)], LOG))["rejected"] == 1
    assert table.seal() == 2 and table.seal() == 0
    assert table.apply(spark.createDataFrame([insert(4, "early"), insert(1, "first")], LOG)) == {"applied": 1, "stale": 1, "rejected": 0}
    assert table.apply(spark.createDataFrame([(21, 2, 2, "renamed", None, 11, False, None)], LOG))["applied"] == 1
    assert named() == {"renamed": 21, "late": 22, "first": 23}


def test_empty_table_and_batch(spark, tmp_path):
    table = ChangeTable.create(spark.createDataFrame([], ROWS), str(tmp_path / "t"))
    assert table.read().collect() == []
    assert table.apply(spark.createDataFrame([], LOG)) == {"applied": 0, "stale": 0, "rejected": 0}
    table.apply(spark.createDataFrame([(None, 1, 1, "one", 3, 1, None, None)], LOG))
    assert [tuple(r) for r in table.read().collect()] == [(1, 1, "one", 3)]
