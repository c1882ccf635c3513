"""A small invented how-to corpus and model outputs, used on both sides of the differential queries."""

from __future__ import annotations

QUERIES = [(1, "how to fix a leaky shower"), (2, "fix leaking faucet"), (3, "how to change engine oil"), (4, "faucet or shower maintenance tips")]
#: (original_index, similarity, text), most similar first
CORPUS = [
    (4, 0.72, "Kitchen faucet drips: shut off supply, unscrew the aerator, replace the washer."),
    (2, 0.66, "A dripping shower often points to a worn valve; symptoms include uneven temperature."),
    (0, 0.61, "Replacing a shower cartridge: turn off the water, remove the handle, pull the old cartridge, install the new one, then test."),
    (1, 0.50, "Change the engine oil and replace the oil filter every 5000 miles."),
    (6, 0.45, "Understanding types of water heater and their efficiency."),
    (5, 0.28, "Seasonal car service schedule and maintenance checklist."),
    (9, 0.25, "Gap each spark plug, then torque to spec."),
    (3, 0.22, "Lube the bicycle chain, clean the cassette, and check chain wear."),
    (7, 0.20, "Patch a bike tire: remove the wheel, lift the tube, apply the patch."),
    (8, 0.10, "Winter travel tips for mountain towns."),
]
#: The documents that answer each query.
RELEVANT = [(1, 0), (1, 2), (2, 4), (3, 1), (4, 4), (4, 0), (4, 2)]
STEPS = [
    (1, "1. Turn off water\n2) Remove handle\n- test, then close; done. ok"),
    (2, "Step 1: check\r- clean\r\n* drain; start. STOP"),
    (3, "no procedure here"),
    (4, ""),
    (5, None),
    (6, "éopen open opené, run; run: Run. a, b, c, d, e, f, g, h, i, j"),
]
BUCKET_OUTPUTS = [
    '{"score": 2}', '{"score": 3}', '{"score":10}', '{"score":5}', '{"score": 2.9}', '{"score": -1}', '{"score": true}', '{"score": "2"}', '{"score":3', "0", "1", "2", "3", "7", "10",
    "2.7", "score 85 then 2", "score: 85", "", "`7`", "'2'", '{"SCORE": 7}', "nothing",
]
BUCKETS = [2, 3, 3, 1, 2, 0, 1, 2, 1, 0, 1, 2, 1, 2, 3, 2, 2, None, None, 2, 2, 2, None]
FINE_OUTPUTS = [
    "FINE_SCORE: 70%", "score=0.72", "42", "0.3", "fine score: 99", "TIE: 70%", "TIE: 0.65", '{"tie": 0.5}', "0.625", "1", "55%", "150", "-5", '{"score": 3}', "{bad}", "no number", "", "about 12 or 34",
]
FINES = [70, 72, 42, 30, 99, 70, 65, 50, 62, 100, 55, 100, 0, 3, None, None, None, 34]
FINE_ERRORS = [None] * 14 + ["json_parse_failed", "parse_failed", "empty_output", None]
FALLBACKS = [(1.0, 0.8, 94), (0.85, 0.62, 78), (0.5, 0.5, 50), (None, 0.5, 15)]
REPLIES = [
    ('{"response": "a"}', "a"), ('{"message": {"content": "b"}}', "b"), ('{"choices": [{"message": {"content": "c"}}]}', "c"), ('{"choices": [{"text": "d"}]}', "d"), ('{"text": "e"}', "e"),
    ('{"done": false}\n{"response": "f"}', "f"), ("plain", "plain"), ("", ""),
]
