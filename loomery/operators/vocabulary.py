"""Banks of names and of utterances to refuse, of our own wording; shares and weights are fixed values."""

from __future__ import annotations

from loomery.functions.banks import Bank, Letters
from loomery.functions.grammar import PINS_S3

ADJ = ["amber", "spare", "tall", "tiny", "dusty", "left", "right", "loud", "quiet", "old", "new", "striped", "middle", "backup"]
PLACE = ["kitchen", "hall", "garden", "attic", "bench", "porch", "shed", "stairs", "cellar", "balcony", "studio", "yard"]
DEVICE = ["lamp", "pump", "heater", "valve", "sign", "vent", "bell", "strip", "motor", "beacon", "fan", "relay"]
#: Words of everyday English and how lopsided their use is.
WORDS = {
    "kettle": 9, "curtain": 7, "toaster": 6, "aquarium": 5, "printer": 5, "ladder": 4, "mirror": 4, "blender": 3, "bucket": 3, "saddle": 2,
    "lantern": 2, "puzzle": 2, "anchor": 2, "carpet": 1, "whistle": 1, "teapot": 1, "mailbox": 1, "hammock": 1, "compass": 1, "trophy": 1,
}
CONSONANTS, VOWELS = list("bdfgklmnprstvz"), list("aeiou")
# Shares of the forms of names, of one-sided words, and of refusals.
ONE_SIDED = 0.55
NAME_FORMS = {
    "{w1} {w2}": 0.1088, "{w1} {device}": 0.0672, "{adj} {w1}": 0.048, "{w1}": 0.0384, "{w1}_{w2}": 0.032, "{place} {w1}": 0.0256,
    "{adj} {device}": 0.15, "{place} {device}": 0.13, "{device}": 0.08, "{adj} {place} {device}": 0.07, "{head}_{device}": 0.049,
    "{device}_{n9}": 0.021, "{device}{n12}": 0.035, "{device} {n12}": 0.035, "{made}": 0.048, "{made} {device}": 0.032, "{made}_{device}": 0.03,
}
GROUP_FORMS = {"{w1} {device}s": 0.132, "{adj} {w1}s": 0.088, "{place} {device}s": 0.26, "{adj} {device}s": 0.2, "{device}s": 0.16, "{set}": 0.16}
BANK_WEIGHTS = {"errand": 14, "smalltalk": 10, "about_you": 16, "opinion": 10, "unfinished": 22}
GENERATOR_WEIGHTS = {"capability": 18, "condition": 12, "question": 10, "relative": 8, "pin_range": 10, "duration": 12, "exception": 10, "gibberish": 4}
# End of fixed values.

_total = sum(WORDS.values())
#: One word in ONE_SIDED of all cases by its weight, else any.
WORD = {w: ONE_SIDED * n / _total + (1 - ONE_SIDED) / len(WORDS) for w, n in WORDS.items()}
_MADE = {
    "made": ["{c1}{v1}{e1}{c2}{v2}{e2}", "{c1}{v1}{e1}{c2}{v2}{e2}{c3}{v3}{e3}"],
    **{f"c{i}": CONSONANTS for i in (1, 2, 3)}, **{f"v{i}": VOWELS for i in (1, 2, 3)}, **{f"e{i}": CONSONANTS + [""] * len(CONSONANTS) for i in (1, 2, 3)},
}
NAME = Bank(NAME_FORMS, **_MADE, w1=WORD, w2=WORD, adj=ADJ, place=PLACE, head=ADJ + PLACE, device=DEVICE, n9=(1, 9), n12=(1, 12))
GROUP_NAME = Bank(GROUP_FORMS, set=["pair of {device}s", "{place} lot", "{adj} crew", "{device} family", "everything by the {place}", "{adj} half"], w1=WORD, adj=ADJ, place=PLACE, device=DEVICE)

_PINS = list(map(str, PINS_S3))
_VERB = ["light", "darken", "wink", "swap", "ripple through", "look at", "wake", "silence"]
_TARGET = ["pin {p}", "the {adj} {device}", "output {p}", "the {device} of the {place}"]
_COMMON = {"target": _TARGET, "adj": ADJ, "place": PLACE, "device": DEVICE, "p": _PINS, "q": _PINS[::-1]}
REFUSALS: dict[str, tuple[Bank, str]] = {
    "errand": (Bank(["order two pizzas", "book a table for four", "play the next song", "call my sister", "add milk to the list", "remind me to water the plants", "find a route to the airport", "send the report again"]), "imperative"),
    "smalltalk": (Bank(["good morning", "that was quick", "nice to meet you", "see you later", "well done", "never mind then", "i am back"]), "neutral"),
    "about_you": (Bank(["what are you able to do", "who made you", "do you ever sleep", "which board is this", "are you listening", "how many words do you know"]), "question"),
    "opinion": (Bank(["it is too warm in here", "i like this colour", "this room feels gloomy", "the neighbours are noisy", "that took far too long"]), "neutral"),
    "unfinished": (Bank(["let pin", "bring the {adj}", "between {p} and", "whichever of the", "and once", "wink the {place}", "starting with {p} and", "look at the", "i need the {adj} {device} to", "have output"], **_COMMON), "imperative"),
    # strengths, colours, tones, clocks, sensors and links between pins: nothing that a level on a pin can say
    "capability": (
        Bank(
            ["bring {target} up little by little", "run {target} at {part} of its strength", "mix a {colour} tone on {target}", "let {target} breathe", "hum at {n} hertz through {target}", "hold {target} at {n} degrees",
             "spell my name with {target}", "feed {target} no more than {volts} volts", "count the pulses that reach pin {p}", "rouse {target} when my alarm rings", "tie {target} to whatever pin {q} shows", "write a diary of pin {p}", "balance {target} against pin {q}"],
            colour=["crimson", "teal", "violet", "ivory", "lime"], part=["a third", "a tenth", "two fifths", "most"], volts=["1.1", "2.2", "4.4"], n=(2, 90), **_COMMON,
        ),
        "imperative",
    ),
    # a command that hangs on a state, a clock or an event
    "condition": (
        Bank(
            ["{clause} {command}", "{command}, {clause}"],
            clause=["as soon as pin {q} lets go", "provided the lid is shut", "the moment it rains", "not before {hour} o'clock", "given that pin {q} answers", "only with pin {q} pulled up", "{n} heartbeats from now", "on the first of the month", "each time somebody knocks", "should pin {q} ever move"],
            command=["wink {target}", "light {target}", "darken {target}", "look at pin {p}", "swap {target}"], n=(2, 90), hour=(1, 23), **_COMMON,
        ),
        "imperative",
    ),
    # sums and facts
    "question": (
        Bank(
            ["how far is it to {place}", "which is more, {a} or {b}", "do {a} and {b} share a divisor", "add {a} to {b}", "explain {topic}", "has {person} ever won a prize", "when did {event} begin", "give me a synonym of {word}"],
            place=["lisbon", "the next bakery", "saturn", "lake titicaca"], topic=["tides", "compound interest", "the plot of faust", "why bread rises"], person=["my neighbour", "clara schumann", "the mayor"],
            event=["the bronze age", "the last regatta", "jazz"], word=["gloomy", "brisk", "tender"], a=(2, 99), b=(2, 99),
        ),
        "question",
    ),
    "relative": (Bank(["once more, but slower", "the one beside it as well", "as you did a minute ago", "take back what you just changed", "its neighbour likewise", "what i said before, word for word", "and then that one", "as it had been"]), "imperative"),
    # a stretch of pins that is not spelt out
    "pin_range": (
        Bank(["{verb} {stretch}"], verb=_VERB, stretch=["all from {low} as far as {high}", "whatever lies between {low} and {high}", "{low} and onwards until {high}", "pin {low} and the {n} after it", "the stretch that begins at {low} and ends at {high}", "outputs {low} .. {high}"], low=_PINS[:8], high=_PINS[10:18], n=(2, 8)),
        "imperative",
    ),
    # a time as the end
    "duration": (
        Bank(["let pin {p} {act} until {n} {unit} have gone by", "{n} {unit} of light on pin {p}", "give pin {p} {n} {unit}, then stop", "have pin {p} {act}, {n} {unit} in all", "after {n} {unit} pin {p} should be done"],
             act=["shine", "wink", "flicker", "rest"], n={str(i): 0.6 / 11 + 0.4 / 89 if i <= 12 else 0.4 / 89 for i in range(2, 91)}, unit=["seconds", "minutes", "hours", "quarters of an hour"], p=_PINS),
        "imperative",
    ),
    # a whole with something taken from it
    "exception": (
        Bank(["leave {some} out and {verb} what remains", "skip {some} but {verb} its neighbours", "{verb} the whole board minus {some}", "spare {some} while you {verb} the board", "{verb} one half of the board", "{some} may stay as it is, {verb} whatever is left over", "{verb} each second output", "{verb} as many as {n} of them"],
             verb=_VERB, some=["pin {low}", "{low} along with {high}", "output {high}"], low=_PINS[:12], high=_PINS[12:], n=(2, 5)),
        "imperative",
    ),
    "gibberish": (Bank(["{a}", "{a} {b}", "{a} {b} {c}", "{a} {b} {c} {d}"], a=Letters(2, 9), b=Letters(2, 9), c=Letters(2, 9), d=Letters(2, 9)), "terse"),
}
KINDS = {**BANK_WEIGHTS, **GENERATOR_WEIGHTS}

#: What is said before and behind, and how often a question mark ends it.
MOODS = {
    "imperative": (["", "please ", "can you ", "could you ", "hey ", "ok "], ["", " please", " now", " for me", " thanks"], 0.05),
    "question": (["", "hey ", "so ", "say, "], ["", " please", " then"], 0.65),
    "neutral": (["", "well ", "hey "], ["", " then", " ok"], 0.10),
    "bare": ([""], ["", " then", " ok"], 0.0),
    "terse": ([""], [""], 0.0),
}
