"""Attention over a row's tokens (the two embeddings of a pair, or one token for each feature) as a classifier.

A class token and the projected tokens go through encoder layers (multi-head attention, then a feed-forward part, each
with a residual and layer norm); the class token's last state gives the log-odds. Forward and backward passes are NumPy
over Arrow batches. GELU is its tanh form, and there is no dropout, so that a run can be repeated.
"""

from __future__ import annotations

import copy
import secrets
import socket
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.operators import metrics
from citeweave.session import delete, shared_path

Params = dict[str, np.ndarray]
#: How many sums of gradients (or files' sums) reach the driver in a step, and how many steps a round has at most.
SUMS, MAX_STEPS = 8, 1000
#: How many of a step's rows are worth a task, and how many are passed through the model at once.
TASK_ROWS, SLICE = 16, 128


def start(n_tokens: int, size: int, width: int, layers: int, hidden: int, shared: bool, seed: int) -> Params:
    """Starting weights; ``shared``: one projection for all tokens, else one for each."""
    rng = np.random.default_rng(seed)

    def dense(*shape: int) -> np.ndarray:
        return rng.normal(0, np.sqrt(2 / (shape[-2] + shape[-1])), shape)

    p = {"in": dense(1 if shared else n_tokens, size, width), "type": rng.normal(0, 0.02, (n_tokens, width)), "class": rng.normal(0, 0.02, width)}
    for i in range(layers):
        p |= {f"{i}.{k}": dense(width, width) for k in ("query", "key", "value", "out")} | {f"{i}.{k}_b": np.zeros(width) for k in ("query", "key", "value", "out", "down")}
        p |= {f"{i}.up": dense(width, hidden), f"{i}.up_b": np.zeros(hidden), f"{i}.down": dense(hidden, width)}
        p |= {f"{i}.{k}": np.ones(width) for k in ("norm1", "norm2")} | {f"{i}.{k}_b": np.zeros(width) for k in ("norm1", "norm2")}
    half = max(1, width // 2)
    return p | {"norm": np.ones(width), "norm_b": np.zeros(width), "head": dense(width, half), "head_b": np.zeros(half), "odds": dense(half, 1), "odds_b": np.zeros(1)}


class _Pass:
    """One forward pass, which keeps for each step how to carry gradients back."""

    def __init__(self, p: Params, heads: int) -> None:
        self.p, self.heads, self.g = p, heads, {k: np.zeros_like(v) for k, v in p.items()}

    def dense(self, x: np.ndarray, k: str):
        def back(d):
            self.g[k] += x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1])
            self.g[k + "_b"] += d.reshape(-1, d.shape[-1]).sum(0)
            return d @ self.p[k].T

        return x @ self.p[k] + self.p[k + "_b"], back

    def norm(self, x: np.ndarray, k: str):
        spread = 1 / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
        z = (x - x.mean(-1, keepdims=True)) * spread

        def back(d):
            self.g[k] += (d * z).reshape(-1, z.shape[-1]).sum(0)
            self.g[k + "_b"] += d.reshape(-1, z.shape[-1]).sum(0)
            e = d * self.p[k]
            return spread * (e - e.mean(-1, keepdims=True) - z * (e * z).mean(-1, keepdims=True))

        return z * self.p[k] + self.p[k + "_b"], back

    @staticmethod
    def gelu(x: np.ndarray):
        t = np.tanh(0.7978845608 * (x + 0.044715 * x**3))
        slope = 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * 0.7978845608 * (1 + 3 * 0.044715 * x**2)
        return 0.5 * x * (1 + t), lambda d: d * slope

    def attend(self, x: np.ndarray, i: int, asked: int):
        """Attention of the first ``asked`` tokens to all."""
        n, _, w = x.shape

        def split(a):
            return a.reshape(n, a.shape[1], self.heads, -1).transpose(0, 2, 1, 3)

        def joined(a):
            return a.transpose(0, 2, 1, 3).reshape(n, -1, w)

        (q, q_back), (k, k_back), (v, v_back) = (self.dense(x[:, :asked] if name == "query" else x, f"{i}.{name}") for name in ("query", "key", "value"))
        q, k, v, scale = split(q), split(k), split(v), 1 / np.sqrt(w // self.heads)
        s = q @ k.transpose(0, 1, 3, 2) * scale
        a = np.exp(s - s.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        y, out_back = self.dense(joined(a @ v), f"{i}.out")

        def back(d):
            d = split(out_back(d))
            da = d @ v.transpose(0, 1, 3, 2)
            ds = a * (da - (da * a).sum(-1, keepdims=True)) * scale
            dx = k_back(joined(ds.transpose(0, 1, 3, 2) @ q)) + v_back(joined(a.transpose(0, 1, 3, 2) @ d))
            dx[:, :asked] += q_back(joined(ds @ k))
            return dx

        return y, back

    def odds(self, x: np.ndarray):
        """Log-odds of x (rows, tokens, size), and how to carry their gradients into ``g``."""
        tokens = np.einsum("nti,tid->ntd", x, np.broadcast_to(self.p["in"], (x.shape[1], *self.p["in"].shape[1:]))) + self.p["type"]
        h = np.concatenate([np.broadcast_to(self.p["class"], (len(x), 1, tokens.shape[2])), tokens], 1)
        steps = []
        layers = sum(k.endswith(".up") for k in self.p)
        for i in range(layers):
            asked = 1 if i == layers - 1 else h.shape[1]  # of the last layer's states only the class token's is used
            y, attend_back = self.attend(h, i, asked)
            h, norm1_back = self.norm(h[:, :asked] + y, f"{i}.norm1")
            u, up_back = self.dense(h, f"{i}.up")
            u, gelu_back = self.gelu(u)
            y, down_back = self.dense(u, f"{i}.down")
            h, norm2_back = self.norm(h + y, f"{i}.norm2")
            steps.append((attend_back, norm1_back, up_back, gelu_back, down_back, norm2_back))
        c, norm_back = self.norm(h[:, 0], "norm")
        c, head_back = self.dense(c, "head")
        c, last_gelu_back = self.gelu(c)
        z, odds_back = self.dense(c, "odds")

        def back(d):
            dh = np.zeros_like(h)
            dh[:, 0] = norm_back(head_back(last_gelu_back(odds_back(d[:, None]))))
            for attend_back, norm1_back, up_back, gelu_back, down_back, norm2_back in reversed(steps):
                dh = norm2_back(dh)
                dh = norm1_back(dh + up_back(gelu_back(down_back(dh))))
                asked, own, dh = dh.shape[1], dh, attend_back(dh)
                dh[:, :asked] += own
            self.g["class"] += dh[:, 0].sum(0)
            self.g["type"] += dh[:, 1:].sum(0)
            each = np.einsum("nti,ntd->tid", x, dh[:, 1:])
            self.g["in"] += each.sum(0, keepdims=True) if len(self.p["in"]) == 1 else each

        return z[:, 0], back


def gradients(p: Params, heads: int, x: np.ndarray, y: np.ndarray, positive_weight: float = 1.0) -> tuple[float, Params]:
    """The mean cross-entropy of 0/1 labels and its gradient; positive rows weigh ``positive_weight``."""
    run = _Pass(p, heads)
    z, back = run.odds(x)
    w = np.where(y > 0, positive_weight, 1.0)
    back(w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y))
    return float((w * (np.logaddexp(0, z) - y * z)).mean()), run.g


def _matrix(column: pa.Array, n_tokens: int, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * n_tokens * size:
        raise ValueError(f"tokens must have length {size}")
    return flat.reshape(len(column), n_tokens, size)


def _flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: Params) -> Params:
    keys = sorted(like)
    ends = np.cumsum([like[k].size for k in keys])[:-1]
    return {k: v.reshape(like[k].shape) for k, v in zip(keys, np.split(flat, ends))}


def _adamw(p: Params, moments: tuple[Params, Params], step: int, g: Params, rate: float, decay: float) -> Params:
    """The weights after a step; its moments are renewed in place."""
    mean, square = moments
    moved = {}
    for k, v in p.items():
        mean[k] = 0.9 * mean[k] + 0.1 * g[k]
        square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
        moved[k] = v - rate * (mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) + decay * v)
    return moved


def _added(p: Params, heads: int, x: np.ndarray, y: np.ndarray, positive_weight: float) -> np.ndarray:
    """The rows' gradients, summed, and last their number."""
    total = np.zeros(sum(v.size for v in p.values()) + 1)
    for at in range(0, len(y), SLICE):
        part = y[at : at + SLICE]
        total[:-1] += _flat(gradients(p, heads, x[at : at + SLICE], part, positive_weight)[1]) * len(part)
    total[-1] = len(y)
    return total


def _joined(context: BarrierTaskContext) -> list[BinaryIO]:
    """Connections of a barrier stage's first task to the others, by rank; of another, that to the first.

    Only the first task's address goes by ``allGather``, which takes a second each time it is called (measured).
    """
    tasks, rank = context.getTaskInfos(), context.partitionId()
    if len(tasks) == 1:
        return []
    host = tasks[0].address.rsplit(":", 1)[0].strip("[]")
    if rank:
        port, key = context.allGather()[0].split()
        to = socket.create_connection((host, int(port)), timeout=60)
        to.settimeout(None)  # Spark ends all tasks of the stage when one fails
        to.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        to.sendall(bytes.fromhex(key) + rank.to_bytes(4, "big"))
        return [to.makefile("rwb")]
    key, found = secrets.token_bytes(16), {}
    with socket.create_server(("", 0), family=socket.AF_INET6 if ":" in host else socket.AF_INET, backlog=len(tasks)) as server:
        context.allGather(f"{server.getsockname()[1]} {key.hex()}")
        server.settimeout(60)
        while len(found) < len(tasks) - 1:
            by, _ = server.accept()
            by.settimeout(10)
            by.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            stream = by.makefile("rwb")
            try:
                said = stream.read(20)
            except OSError:
                continue  # no task of ours
            if secrets.compare_digest(said[:16], key):
                by.settimeout(None)
                found[int.from_bytes(said[16:], "big")] = stream
    return [found[r] for r in sorted(found)]


def _received(stream: BinaryIO, n_bytes: int) -> np.ndarray:
    found = stream.read(n_bytes)
    if len(found) < n_bytes:
        raise ConnectionError("another task of the round has ended")
    return np.frombuffer(found)


def _slots(spark: SparkSession) -> int:
    """How many tasks a barrier stage may have: none with dynamic allocation, else as many as run at once."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def _of_steps(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of one step, of batches (place of the step, x, y) in the order of steps."""
    for found in batches:
        at, x, y = found.column(0).to_numpy(), _matrix(found.column(1), *shape), found.column(2).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
        for lo, hi in zip([0, *ends], ends):
            yield int(at[lo]), x[lo:hi], y[lo:hi]


class Attention:
    """Columns of ``tokens`` are arrays of one length (embeddings), or numbers (a token each, with its own projection).

    Scale the columns first. Training is synchronous: rows are dealt to steps of about ``batch`` rows by a hash of their
    values (MAX_STEPS at most, written once in that order), a step's gradient is summed over all tasks, and one AdamW state
    moves the weights. A round is one barrier stage: its tasks hold equal shares of each step and pass their sums to the
    first, which answers with the new weights. Barrier stages don't go with dynamic allocation; there a step is a job, its
    sums meet on the driver, and the weights are the same (but for the last digits). So weights don't depend on the partitioning (but for the last digits of sums), and a
    step that many equal rows fall into is only larger. Each round goes through all steps in a keyed order. With
    validation rows the weights of the best weighted F1 are kept. Nulls are zeros; rows without a label don't count;
    arrays of another length fail.
    """

    def __init__(self, name: str, tokens: Sequence[str], size: int = 1, label: str = "is_reference_valid", width: int = 64, heads: int = 8, layers: int = 2, hidden: int | None = None, rate: float = 1e-3, decay: float = 1e-4, batch: int = 512, seed: int = 42) -> None:
        if width % heads:
            raise ValueError("width must be a multiple of heads")
        self.name, self.tokens, self.size, self.label = name, list(tokens), size, label
        self.heads, self.rate, self.decay, self.batch, self.seed = heads, rate, decay, batch, seed
        self.shape = {"width": width, "layers": layers, "hidden": hidden or 2 * width}
        self.params = start(len(self.tokens), size, width, layers, hidden or 2 * width, size > 1, seed)
        self.moments: tuple[Params, Params] = tuple({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        self.step = 0

    def _inputs(self):
        if self.size == 1:
            return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.tokens))
        zeros = F.array_repeat(F.lit(0.0), self.size)
        return F.concat(*(F.coalesce(F.transform(F.col(c), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), zeros) for c in self.tokens))

    def _gradient(self, rows: DataFrame, positive_weight: float) -> Params:
        """The mean gradient of the rows (x, y), of which there is one at least."""
        shape, heads = (len(self.tokens), self.size), self.heads
        sent = rows.sparkSession.sparkContext.broadcast(self.params)  # the model: its size is set by the parameters

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(_added(sent.value, heads, _matrix(b.column(0), *shape), b.column(1).to_numpy(zero_copy_only=False), positive_weight) for b in batches)
            if np.ndim(total):
                yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(g) for b in batches for g in b.column(0).to_pylist())
            if np.ndim(total):
                yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

        sums = rows.select("x", "y").mapInArrow(partial, "g binary")
        if len(rows.inputFiles()) > SUMS:  # a small step's few sums need no second stage
            sums = sums.repartition(SUMS, F.xxhash64("g")).mapInArrow(summed, "g binary")
        total = sum(np.frombuffer(g) for g in sorted(bytes(r["g"]) for r in sums.collect()))
        sent.unpersist()
        return _shaped(total[:-1] / total[-1], self.params)

    def _round(self, rows: DataFrame, steps: int, positive_weight: float) -> None:
        """All steps in one barrier stage, of rows (place of the step, x, y) in that order in each partition."""
        shape, heads, rate, decay = (len(self.tokens), self.size), self.heads, self.rate, self.decay
        sent = rows.sparkSession.sparkContext.broadcast((self.params, self.moments, self.step))  # sizes set by the parameters

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = BarrierTaskContext.get()
            streams, first = _joined(context), context.partitionId() == 0
            params, moments, taken = copy.deepcopy(sent.value)
            runs, none = _of_steps(batches, shape), (steps, None, None)
            run = next(runs, none)
            for step in range(steps):
                total = np.zeros(sum(v.size for v in params.values()) + 1)
                while run[0] == step:
                    total += _added(params, heads, *run[1:], positive_weight)
                    run = next(runs, none)
                if first:
                    for stream in streams:
                        total += _received(stream, total.nbytes)
                    if total[-1]:
                        taken += 1
                        params = _adamw(params, moments, taken, _shaped(total[:-1] / total[-1], params), rate, decay)
                    moved = _flat(params).tobytes()
                for stream in streams:
                    stream.write(moved if first else total.tobytes())
                    stream.flush()
                if not first:
                    params = _shaped(_received(streams[0], total.nbytes - 8), params)
            for stream in streams:
                stream.close()
            if first:
                yield pa.RecordBatch.from_pydict({"step": [taken], "tensors": [[_flat(p).tobytes() for p in (params, *moments)]]})

        (done,) = rows.mapInArrow(trained, "step long, tensors array<binary>", barrier=True).collect()
        sent.unpersist()
        self.step = done["step"]
        self.params, *moments = (_shaped(np.frombuffer(t).copy(), self.params) for t in done["tensors"])
        self.moments = tuple(moments)

    def train(self, rows: DataFrame, validation: DataFrame | None = None, rounds: int = 5, patience: int = 2) -> Attention:
        spark = rows.sparkSession
        n, positive = rows.agg(F.count(self.label), F.coalesce(F.sum(self.label), F.lit(0))).first()
        if not n:
            return self
        weight = (n - positive) / positive if positive and n > positive else 1.0
        steps = min(MAX_STEPS, max(1, n // self.batch))
        known = rows.where(F.col(self.label).isNotNull()).select(self._inputs().alias("x"), F.col(self.label).cast("double").alias("y"))
        path = shared_path(spark, "steps")
        dealt = known.withColumn("step", F.pmod(F.xxhash64(F.lit(self.seed), "x", "y"), F.lit(steps)).cast("int")).hint("rebalance", "step")
        as_jobs = not _slots(spark)
        if as_jobs:
            dealt.write.partitionBy("step").parquet(path)
            there = {r["step"] for r in spark.read.parquet(path).select("step").distinct().collect()}  # MAX_STEPS at most
        else:  # rows of a step are numbered on end, so that tasks get equal shares of it
            dealt.sortWithinPartitions("step").withColumn("i", F.monotonically_increasing_id()).write.parquet(path)
            tasks = min(_slots(spark), -(-n // (steps * TASK_ROWS)))
        order = np.random.default_rng(self.seed)
        best, kept, behind = -1.0, self.params, 0
        for _ in range(rounds):
            turns = order.permutation(steps)
            if as_jobs:
                for s in turns.tolist():
                    if s in there:
                        g = self._gradient(spark.read.schema("x array<double>, y double").parquet(f"{path}/step={s}"), weight)
                        self.step += 1
                        self.params = _adamw(self.params, self.moments, self.step, g, self.rate, self.decay)
            else:
                share = spark.read.schema("step int, i long, x array<double>, y double").parquet(path).repartitionById(tasks, F.pmod("i", F.lit(tasks)).cast("int"))
                places = F.get(F.lit(np.argsort(turns).tolist()), "step").alias("place")
                self._round(share.select(places, "x", "y").sortWithinPartitions("place"), steps, weight)
            if validation is None:
                continue
            score = metrics.weighted_scores(self.predict(validation), self.label).first()["f1"] or 0.0
            best, kept, behind = (score, self.params, 0) if score > best else (best, kept, behind + 1)
            if behind >= patience:
                break
        if validation is not None:
            self.params = kept
        delete(spark, path)
        return self

    def evaluate(self, rows: DataFrame) -> DataFrame:
        return metrics.weighted_scores(self.predict(rows), self.label)

    def save_into(self, at: str) -> None:
        """The weights and moments as a table of tensors, under a folder."""
        spark = SparkSession.active()
        rows = [(kind, k, list(v.shape), v.ravel().tolist()) for kind, own in (("weight", self.params), ("mean", self.moments[0]), ("square", self.moments[1])) for k, v in sorted(own.items())]
        spark.createDataFrame([("step", "", [], [float(self.step)]), *rows], "kind string, name string, shape array<int>, numbers array<double>").coalesce(1).write.parquet(f"{at}/tensors")

    def load_from(self, at: str) -> Attention:
        found: dict[str, Params] = {}
        for r in SparkSession.active().read.parquet(f"{at}/tensors").collect():  # the model
            found.setdefault(r["kind"], {})[r["name"]] = np.array(r["numbers"]).reshape(r["shape"])
        if {k: v.shape for k, v in found["weight"].items()} != {k: v.shape for k, v in self.params.items()}:
            raise ValueError("the weights are of a model of another shape")
        self.params, self.moments, self.step = found["weight"], (found["mean"], found["square"]), int(found["step"][""])
        return self

    def predict(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds probability (of class 1) and prediction."""
        shape, heads, batch = (len(self.tokens), self.size), self.heads, self.batch
        sent = rows.sparkSession.sparkContext.broadcast(self.params)
        schema = T.StructType([*rows.schema.fields, T.StructField("probability", T.DoubleType())])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in batches:
                x = _matrix(found.column(found.num_columns - 1), *shape)
                z = [_Pass(sent.value, heads).odds(x[at : at + batch])[0] for at in range(0, len(x), batch)]
                p = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -30, 30)))
                yield pa.RecordBatch.from_arrays([*found.columns[:-1], pa.array(p)], [*found.schema.names[:-1], "probability"])

        return metrics.at_threshold(rows.withColumn("_tokens", self._inputs()).mapInArrow(scored, schema), "probability", threshold)
