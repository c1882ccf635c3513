"""The word lists, tables and patterns that define the built-in how-to policies."""

STOPWORDS = "a an and are be for how i in is it of on or that the they this to was we were what why with you".split()
OVERLAP_STOPWORDS = "a and are be for how in is it of on or that the this to was were with".split()

PROCEDURE_VERBS = (
    "check clean close disconnect drain install open pull push reassemble reconnect remove replace run screw shut start stop test tighten turn unscrew"
).split()
STEP_WORDS = "after afterward before finally first next once step then".split()
ACTION_VERBS = (
    "align apply assemble bleed change check clean close disconnect drain fix flush inspect install lift loosen lube lubricate maintain measure "
    "open press pull push reassemble reconnect remove repair replace screw seal service shut swap test tighten torque turn unscrew use"
).split()
STEP_MARKERS = ["1)", "2)", "3)", "after", "before", "finally", "finish by", "first", "next", "second", "start by", "step", "steps", "then"]
EXPLANATORY_HINTS = ["guide to", "introduction", "overview", "symptoms", "types of", "understanding", "what is"]
PART_WORDS = (
    "aerator belt brake cartridge cassette chain coil derailleur drain faucet filter handle hose nut o-ring oil oring packing pads pipe plug "
    "rotor seat shower socket spark spout stem supply tire tires torque tube valve washer"
).split()

STEP_BULLET = r"(?md)^\s*(?:\d+[)\.:]|[-*+])\s+"
STEP_SEPARATOR = r"[.;:]\s+|,\s+"
YEAR = r"\b(19|20)\d{2}\b"

INTENT_HOWTO = "change fix guide how install remove repair replace steps troubleshoot tutorial".split()
INTENT_DIAGNOSE = "cause diagnose issues problem symptoms why".split()
INTENT_OVERVIEW = "basics checklist guide interval maintain maintaining maintenance overview routine schedule service tips".split()
INTENT_INFO = "difference explain types understanding what".split()
CONTEXT_INTENT = INTENT_HOWTO + "care maintain maintenance routine service servicing upkeep".split()

SCHEDULE_TOKENS = "maintenance service schedule interval routine inspect".split()
KIND_HOWTO_PHRASES = ["how to", "steps to", "step-by-step", "step by step"]
KIND_REPAIR_TOKENS = "fix repair replace install remove leak drip".split()
KIND_MAINTENANCE_TOKENS = "maintenance maintaining maintain service servicing interval schedule routine checklist".split()
KIND_OIL_PHRASES = ["engine oil", "oil change", "oil filter", "viscosity", "synthetic", "miles", "interval"]
KIND_INFO_PHRASES = ["types of", "understanding", "overview", "guide to"]

CLIENT_MAINTENANCE = "care checklist interval maintain maintaining maintenance routine schedule service servicing upkeep".split()
CLIENT_TRIGGERS = "help issue maintenance problem".split()
CLIENT_VERBS = "turn remove install replace tighten loosen use check inspect clean lube lubricate".split()
CLIENT_DOMAINS = [
    ("plumbing", ["shower", "faucet", "plumbing", "pipe", "cartridge", "valve", "water heater"]),
    ("automotive", ["car", "engine", "oil", "brake", "spark", "civic", "automotive"]),
    ("bicycle", ["bicycle", "bike", "chain", "derailleur", "cassette", "tire"]),
]
GENERIC_DOMAINS = [
    ("plumbing", "cartridge drain faucet heater pipe plumbing shower valve water".split()),
    ("automotive", "auto automotive brake car engine lug oil spark torque".split()),
    ("bicycle", "bicycle bike cassette chain derailleur tire wheel".split()),
]
#: (domain, whole words); hits of rules with the same name add up.
DOMAIN_RULES = [
    ("automotive", "auto automotive brake car civic engine lug oil spark torque".split()),
    ("bicycle", "bicycle bike cassette chain chains derailleur pump tire wheel".split()),
    ("plumbing", "bath cartridge drain faucet pipe plumber plumbing shower tub valve".split()),
    ("plumbing", ["heater", "water heater"]),
]

KINDS = ("PROCEDURAL", "DIAGNOSTIC", "OVERVIEW", "INFORMATIONAL", "UNKNOWN")
KIND_RANK = {"PROCEDURAL": 4, "DIAGNOSTIC": 3, "OVERVIEW": 2, "INFORMATIONAL": 1, "UNKNOWN": 0}
#: Query intent by document kind, in the order of KINDS.
INTENT_FIT = {
    "HOWTO": (1.0, 0.7, 0.6, 0.4, 0.5),
    "OVERVIEW": (0.75, 0.7, 1.0, 0.45, 0.6),
    "DIAGNOSE": (0.7, 1.0, 0.6, 0.5, 0.5),
    "INFO": (0.5, 0.6, 0.7, 1.0, 0.5),
    "UNKNOWN": (0.85, 0.85, 0.85, 0.85, 0.85),
}
CLIENT_INTENT_FIT = {"OVERVIEW": (0.8, 0.6, 1.0, 0.6, 0.7), "UNKNOWN": (0.8, 0.7, 0.8, 0.7, 0.7)}
