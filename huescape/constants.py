"""Fixed values of the analysis. All of them bear on results."""

#: CIELAB units of one just-noticeable difference; edges of fine and of coarse bins.
JND = 2.3
FINE, COARSE = 1.0 * JND, 5.0 * JND
#: Images with more pixels, or a longer side, are rejected. Longest edge after downscaling.
MAX_PIXELS, MAX_SIDE, WORK_SIDE = 50_000_000, 10_000, 256
#: Degrees of hue that belong together.
HUE_RANGE = 30.0
#: Chains are walked from so many seeds for each direction; pairs of bins need so many edges, and so one-sided ones.
SEEDS, MIN_EDGES, MIN_ASYMMETRY, MIN_CHAIN = 50, 10, 0.3, 3
#: What a gradient must span (L + a + b), its greatest mean turn in degrees, and the chroma at which a stop counts for families.
MIN_SPAN, MAX_TURN, STOP_CHROMA = 40.0, 74.0, 8.0
#: Notable colours and gradients at most; significance needed, as a share of the greatest.
MOST, MIN_SHARE = 10, 0.05
#: Penalty for similarity: distance at which it ends, coverage at which it is lifted, its weight.
SIMILAR, ANCHOR, PENALTY = 25.0, 0.05, 30.0
#: Pairs: lightness difference of contrasts, chroma of harmonies, how many of each are shown.
CONTRAST_L, HARMONY_CHROMA, PAIRS = 30.0, 15.0, 5
#: Directions, in the order in which chains are sought: with their opposite, and the step (rows, columns).
DIRECTIONS = ("right", "left", "below", "above", "down_right", "down_left", "up_right", "up_left")
