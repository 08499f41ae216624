"""Full-batch descent over all rows in one Spark job: a barrier stage whose tasks keep their rows and sum gradients among them.

Every task runs the same program on the rows that it holds. Where the program needs sums over all rows, tasks send theirs to
the first task, which adds them up in the tasks' order and answers all, so that all of them take the same step. Sums are a
few numbers for each key; rows never leave their task, and no task needs to hold a key's rows together.

``BarrierTaskContext.allGather`` tells the tasks each other's keys and where the first one listens. The sums themselves
go by plain connections: Spark looks for the answers to an allGather once a second, which 500 steps can't wait for.
"""

from __future__ import annotations

import hmac
import json
import secrets
import socket
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks of the barrier stage at most, which all send to the first one; and seconds that a task waits for another's sums.
MOST_TASKS, PATIENCE = 256, 600


def _read(connection: socket.socket, size: int) -> bytearray:
    data = bytearray(size)
    view, have = memoryview(data), 0
    while have < size:
        got = connection.recv_into(view[have:])
        if not got:
            raise ConnectionError("another task of the fit has ended")
        have += got
    return data


class Share:
    """A task's rows, as arrays sorted by key, and sums over the rows of all tasks."""

    def __init__(self, context: BarrierTaskContext, frame: pd.DataFrame, columns: list[str]):
        tasks, own, told = context.getTaskInfos(), context.partitionId(), {"keys": sorted(frame["_key"].unique())}
        server = None
        if own == 0:
            server = socket.create_server(("", 0), backlog=len(tasks))
            told |= {"port": server.getsockname()[1], "word": secrets.token_hex(16)}
        heard = [json.loads(m) for m in context.allGather(json.dumps(told))]
        self.keys = sorted({k for h in heard for k in h["keys"]})
        self._others = self._met(server, heard[0]["word"].encode(), len(tasks)) if own == 0 else []
        hosts = [t.address.rsplit(":", 1)[0] for t in tasks]
        self._first = None if own == 0 else self._joined("127.0.0.1" if hosts[own] == hosts[0] else hosts[0], heard[0], own)
        order = np.argsort(frame["_key"].to_numpy(), kind="stable")
        self.values = {c: frame[c].to_numpy()[order] for c in columns}
        places = np.searchsorted(frame["_key"].to_numpy()[order], self.keys) if len(frame) else np.zeros(len(self.keys), int)
        self.slices = [slice(int(a), int(b)) for a, b in zip(places, [*places[1:], len(frame)], strict=True)]

    @staticmethod
    def _met(server: socket.socket, word: bytes, tasks: int) -> list[socket.socket]:
        others: dict[int, socket.socket] = {}
        server.settimeout(PATIENCE)
        with server:
            while len(others) < tasks - 1:
                connection, _ = server.accept()
                connection.settimeout(PATIENCE)
                said = _read(connection, len(word) + 4)
                if hmac.compare_digest(bytes(said[4:]), word):
                    others[int.from_bytes(said[:4], "big")] = connection
                else:
                    connection.close()
        for c in others.values():
            c.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return [others[i] for i in sorted(others)]

    @staticmethod
    def _joined(host: str, first: dict, own: int) -> socket.socket:
        connection = socket.create_connection((host, first["port"]), PATIENCE)
        connection.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        connection.sendall(own.to_bytes(4, "big") + first["word"].encode())
        return connection

    def close(self) -> None:
        for c in [*self._others, *([self._first] if self._first else [])]:
            c.close()

    def total(self, of_slice: Callable[[int, slice], np.ndarray]) -> np.ndarray:
        """The sums over all tasks of what ``of_slice`` gives for each key (its number, and where its rows are)."""
        local = np.array([of_slice(i, s) for i, s in enumerate(self.slices)], "<f8")
        if self._first:
            self._first.sendall(local.tobytes())
            return np.frombuffer(_read(self._first, local.nbytes), "<f8").reshape(local.shape)
        for c in self._others:
            local += np.frombuffer(_read(c, local.nbytes), "<f8").reshape(local.shape)
        for c in self._others:
            c.sendall(local.tobytes())
        return local


def fit_by_key(rows: DataFrame, keys: list[str], columns: dict[str, Column], program: Callable[[Share], list[dict | None]], schema: str, tasks: int | None = None) -> DataFrame:
    """What ``program`` makes of the number ``columns`` of ``rows`` for each of the ``keys``: keys, then ``schema``.

    The program runs in every task and returns a row or None for each of ``Share.keys``, the same everywhere. A key that no
    row has gives nothing. ``tasks`` are as many as run at once, since all of a barrier stage must, and ``MOST_TASKS`` at
    most. Barrier stages need fixed executors (``spark.dynamicAllocation.enabled`` off); a lost one runs the stage again.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names, numbers = [*keys, *(c.split()[0] for c in schema.split(", "))], list(columns)
    held = rows.select(F.to_json(F.struct(*keys)).alias("_key") if keys else F.lit("{}").alias("_key"), *[v.cast("double").alias(c) for c, v in columns.items()])

    def run(frames):
        context = BarrierTaskContext.get()
        mine = [f for f in frames if len(f)]
        share = Share(context, pd.concat(mine, ignore_index=True) if mine else pd.DataFrame(columns=["_key", *numbers]), numbers)
        try:
            made = program(share) if share.keys else []
        finally:
            share.close()
        out = [{**json.loads(k), **r} for k, r in zip(share.keys, made, strict=True) if r is not None]
        if out and context.partitionId() == 0:
            yield pd.DataFrame(out, columns=names)

    n = tasks or max(1, min(rows.sparkSession.sparkContext.defaultParallelism, MOST_TASKS))
    found = held.repartition(n).mapInPandas(run, f"{kinds}, {schema}" if keys else schema, barrier=True)
    return found.repartition(1)  # one row a key; a barrier stage can't be read in part, what follows it can
