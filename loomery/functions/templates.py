"""What commands are said as: templates of our own wording, {r} being the target."""

HEADS = {
    "set": {
        "high": ["turn on {r}", "switch on {r}", "{r} on", "wake {r}", "let {r} shine", "send current through {r}", "give {r} its signal", "i need {r} alight"],
        "low": ["turn off {r}", "switch off {r}", "{r} off", "put {r} to sleep", "silence {r}", "take the signal from {r}", "let {r} go dark", "no more current for {r}"],
        "toggle": ["turn {r} about", "switch {r} over", "the opposite for {r}", "trade places on {r}", "whatever {r} is now, change it"],
    },
    "read": ["read {r}", "look at {r}", "what does {r} say", "does {r} carry a signal", "is there anything on {r}", "listen to {r}", "take a reading of {r}", "let me know about {r}"],
    "blink": ["flicker {r}", "make {r} wink", "blink {r}", "let {r} come and go", "have {r} glimmer", "keep tapping {r}", "twinkle with {r}"],
    "seq": ["run through {r}", "send a wave over {r}", "one by one {r}", "pass the light along {r}", "hand it down the line of {r}", "wander over {r}"],
    "stop": ["enough of {r}", "end {r}", "let go of {r}", "leave off with {r}", "have {r} rest", "no more of {r}"],
    "alias": ["make a note that {r}", "as of today {r}", "be aware that {r}", "let it stand that {r}", "you should know {r}"],
}


def openings() -> list[str]:
    """What a command may open with: the templates that end in their target, without it, the longest first."""
    every = [t for bank in HEADS.values() for t in (bank if isinstance(bank, list) else sum(bank.values(), []))]
    return sorted({t.removesuffix(" {r}") for t in every if t.endswith(" {r}")}, key=lambda o: (-len(o), o))
