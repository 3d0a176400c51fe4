"""The alias table of each device as keyed streaming state: define, forget, look up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The device's bounds.
MAX_ALIASES, ALIAS_PINS, NAME_BYTES = 16, 6, 48
# End of fixed values.
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t_-", "abcdefghijklmnopqrstuvwxyz   ")
OUT = "device long, event_id long, op string, name string, ok boolean, n_aliases int, pins array<int>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(name: str) -> str:
    """The device's one folding, as alias_norm() has it: ASCII alone, blanks collapsed."""
    return " ".join(w for w in name.translate(_FOLD).split(" ") if w)


def step(table: dict[str, list[int]], op: str, name: str | None, pins) -> tuple[bool, list[int]]:
    """Applies one command to a table in place: (did it work, the pins of the name).

    A null or blank name, one longer than NAME_BYTES, and a definition without pins, with a null one or with more than
    ALIAS_PINS do nothing.
    """
    name = fold(name or "")
    if not name or len(name.encode("utf-8", "surrogatepass")) > NAME_BYTES:
        return False, []
    if op == "define":
        wanted = [int(p) for p in pins if p is not None and p == p] if pins is not None else []
        fits = 0 < len(wanted) <= ALIAS_PINS and len(wanted) == len(pins) and (name in table or len(table) < MAX_ALIASES)
        if fits:
            table[name] = wanted
        return fits, wanted if fits else []
    if op == "forget":
        if name not in table:
            return False, []
        last = list(table)[-1]  # the last one takes the place of the one that goes
        rows = [(last, table[last]) if n == name else (n, v) for n, v in table.items() if n == name or n != last]
        rows = [r for r in rows if r[0] != name]
        table.clear()
        table.update(rows)
        return True, []
    return name in table, table.get(name, [])


def restored(names, pins) -> dict[str, list[int]]:
    """A table from its stored form; one that breaks the device's bounds is refused."""
    table = dict(zip(list(names), [[int(p) for p in own] for own in pins]))
    if len(names) != len(pins) or len(table) > MAX_ALIASES or any(len(v) > ALIAS_PINS for v in table.values()):
        raise ValueError("the stored table of aliases is damaged")
    return table


class AliasTable(StatefulProcessor):
    """The table of a device as map state: a name's pins, and its place in the table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("aliases", "norm string", "pins array<int>, place int")

    def _table(self) -> dict[str, list[int]]:
        held = sorted((v[1], k[0], list(v[0])) for k, v in self.entries.iterator())
        return restored([name for _, name, _ in held], [pins for _, _, pins in held])

    def _keep(self, before: dict, after: dict) -> None:
        """Writes what changed: a name's pins or its place."""
        placed = {name: (pins, i) for i, (name, pins) in enumerate(before.items())}
        for name in before.keys() - after.keys():
            self.entries.removeKey((name,))
        for i, (name, pins) in enumerate(after.items()):
            if placed.get(name) != (pins, i):
                self.entries.updateValue((name,), (pins, i))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803 (Spark's names)
        before = self._table()
        after = dict(before)
        step(after, "define", initialState["name"], initialState["pins"])
        self._keep(before, after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self._table()
        table = {name: list(pins) for name, pins in before.items()}
        for r in sorted(rows, key=lambda r: r["event_id"]):
            ok, found = step(table, r["op"], r["name"], r["pins"])
            yield Row(device=key[0], event_id=r["event_id"], op=r["op"], name=r["name"], ok=ok, n_aliases=len(table), pins=found)
        self._keep(before, table)

    def close(self) -> None:
        pass


def alias_stream(commands: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """commands (device, event_id, op, name, pins), answered in order of event_id within a trigger and device.

    A stream or a table; a table is one trigger. known (device, name, pins) is what devices know before a stream's first
    trigger, in no certain order. The state is kept by RocksDB, which this sets for the session.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    _ = commands.sparkSession.streams.active  # a table needs the coordinator of state stores too, which the session's streams start
    start = None if known is None else known.select("device", "name", "pins").groupBy("device")
    return commands.groupBy("device").transformWithState(AliasTable(), OUT, "append", "none", start)


def stored_aliases(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(device, name, pins, place): the tables of all devices as a stream's checkpoint has them, for any reader of tables."""
    state = spark.read.format("statestore").option("stateVarName", "aliases").load(checkpoint)
    return state.select(F.col("key.device").alias("device"), F.col("user_map_key.norm").alias("name"), F.col("user_map_value.pins").alias("pins"), F.col("user_map_value.place").alias("place"))
