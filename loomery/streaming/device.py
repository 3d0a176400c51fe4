"""A board that carries out commands: names, animations and pin levels as the state of each device, as a stream or a replay.

A command goes through fixed stages: giving a name is settled first (its pins are checked, its name need not exist), then names
become pins, then the board checks, then it acts. A pin is in one animation at most: setting, stopping or animating it again
ends the one it is in. Intervals and rounds that are left out are the device's defaults, and only here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from loomery.functions.grammar import DEVICE_PINS, INTERVAL_MAX, INTERVAL_MIN, MAX_SEQ_PINS, PINS_S3
from loomery.streaming.aliases import fold, step

# The device's bounds and defaults.
SLOTS = 8
BLINK_MS, CHASE_MS = 500, 200
# End of fixed values.

OUT = "device long, event_id long, action string, verdict string, busy_slots int, high_pins array<int>"
STATE = "names array<string>, named array<array<int>>, high array<int>, slots array<struct<mode:string,pins:array<int>,ms:int,rounds:int,at:int,done:int>>"


class Board:
    def __init__(self, pins=PINS_S3):
        self.pins, self.high, self.names = list(pins), set(), {}
        self.slots: list[dict | None] = [None] * SLOTS

    # --- animations
    def slot_of(self, pin: int) -> int | None:
        """The first live slot that holds a pin."""
        return next((i for i, s in enumerate(self.slots) if s and pin in s["pins"]), None)

    def end(self, slot: int | None) -> None:
        if slot is not None and self.slots[slot]:
            self.high -= set(self.slots[slot]["pins"])
            self.slots[slot] = None

    def free(self) -> int | None:
        return next((i for i, s in enumerate(self.slots) if s is None), None)

    def tick(self, slot: int) -> None:
        """One call of a slot's timer: a blink turns its pin over, a chase moves on; rounds end it, none never do."""
        s = self.slots[slot]
        if s is None:
            return
        if s["mode"] == "blink":
            pin = s["pins"][0]
            self.high ^= {pin}
            ended = pin not in self.high
        else:
            self.high.discard(s["pins"][s["at"]])
            s["at"] = (s["at"] + 1) % len(s["pins"])
            ended = s["at"] == 0
        s["done"] += ended
        if ended and 0 < s["rounds"] <= s["done"]:
            self.end(slot)
        elif s["mode"] == "seq":
            self.high.add(s["pins"][s["at"]])

    # --- commands
    def run(self, action, pins, names, every=False, level=None, ms=None, rounds=None) -> str:
        """The verdict on one command, carried out if it is `execute`."""
        pins, names = [int(p) for p in (pins if pins is not None else [])], list(names) if names is not None else []
        if action == "alias":
            verdict = self.checked(action, pins, ms)
            if verdict == "execute" and (len(names) != 1 or not step(self.names, "define", names[0], pins)[0]):
                verdict = "no_room"
            return verdict
        for name in names:
            own = self.names.get(fold(name or ""))
            if own is None:
                return "unknown_name"
            if len(pins) + len(own) > DEVICE_PINS:
                return "too_many_pins"
            pins = pins + own
        if action == "seq" and names and len(pins) < 2:
            return "name_too_few_pins"
        verdict = self.checked(action, pins, ms)
        return self.act(action, pins, every, level, ms, rounds) if verdict == "execute" else verdict

    def checked(self, action, pins, ms) -> str:
        if action not in ("set", "read", "blink", "seq", "stop", "alias"):
            return "unknown"
        if any(p not in self.pins for p in pins):
            return "bad_pin"
        if action == "seq" and len(pins) > MAX_SEQ_PINS:
            return "too_many_pins"
        return "bad_interval" if ms is not None and not INTERVAL_MIN <= ms <= INTERVAL_MAX else "execute"

    def act(self, action, pins, every, level, ms, rounds) -> str:
        if action == "set":
            if every and level != "toggle":
                for i in range(SLOTS):
                    self.end(i)
            for pin in self.pins if every else pins:
                if not every:
                    self.end(self.slot_of(pin))
                up = pin not in self.high if level == "toggle" else level == "high"
                (self.high.add if up else self.high.discard)(pin)
        elif action == "blink":
            if every:
                return "cannot_blink_all"
            for pin in pins:
                slot = self.slot_of(pin)
                slot = self.free() if slot is None else slot
                if slot is None:
                    return "slots_busy"
                self.end(slot)
                self.high.discard(pin)
                self.slots[slot] = {"mode": "blink", "pins": [pin], "ms": BLINK_MS if ms is None else int(ms), "rounds": int(rounds or 0), "at": 0, "done": 0}
        elif action == "seq":
            for pin in pins:
                self.end(self.slot_of(pin))
            slot = self.free()
            if slot is None:
                return "slots_busy"
            self.high = (self.high - set(pins)) | {pins[0]}
            self.slots[slot] = {"mode": "seq", "pins": pins, "ms": CHASE_MS if ms is None else int(ms), "rounds": int(rounds or 0), "at": 0, "done": 0}
        elif action == "stop":
            for slot in [self.slot_of(p) for p in pins] if pins else range(SLOTS):
                self.end(slot)
        return "execute"

    # --- as state
    def stored(self) -> tuple:
        return list(self.names), list(self.names.values()), sorted(self.high), [tuple(s.values()) if s else ("", [], 0, 0, 0, 0) for s in self.slots]

    @classmethod
    def restored(cls, names, named, high, slots) -> Board:
        """A board from its state; state that breaks the device's bounds is refused."""
        board = cls()
        board.names, board.high = {n: [int(p) for p in v] for n, v in zip(names, named)}, {int(p) for p in high}
        board.slots = [dict(zip(("mode", "pins", "ms", "rounds", "at", "done"), (s[0], [int(p) for p in s[1]], *map(int, list(s)[2:])))) if s[0] else None for s in slots]
        if len(board.slots) != SLOTS or not board.high <= set(board.pins) or any(len(v) > DEVICE_PINS for v in board.names.values()):
            raise ValueError("stored state is not of this device")
        return board


def _whole(x):
    return None if x is None or x != x else int(x)


def answer(board: Board, r) -> tuple:
    verdict = board.run(r.action, r.pins, r.names, bool(r.every), r.level, _whole(r.interval_ms), _whole(r.rounds))
    return r.device, r.event_id, r.action, verdict, sum(s is not None for s in board.slots), sorted(board.high)


COLUMNS = ["device", "event_id", "action", "verdict", "busy_slots", "high_pins"]


def _update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    board = Board.restored(*state.get) if state.exists else Board()
    rows = pd.concat(list(batches)).sort_values("event_id", kind="stable")
    out = [answer(board, r) for r in rows.itertuples()]
    state.update(board.stored())
    yield pd.DataFrame(out, columns=COLUMNS)


def device_stream(commands: DataFrame) -> DataFrame:
    """commands (device, event_id, action, pins, names, every, level, interval_ms, rounds), a stream, answered in order of event_id."""
    return commands.groupBy("device").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def device_replay(commands: DataFrame) -> DataFrame:
    """The same for a table: devices are sorted apart and each is followed in order, with the state of one board in memory."""
    ordered = commands.repartition("device").sortWithinPartitions("device", "event_id")

    def run(batches):
        now, board = object(), Board()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.device != now:
                    now, board = r.device, Board()
                out.append(answer(board, r))
            yield pd.DataFrame(out, columns=COLUMNS)

    return ordered.mapInPandas(run, OUT)
