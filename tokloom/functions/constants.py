"""Fixed values that must equal the reference's for the same results.

They are stated here plainly, once, in natural order.
"""

# --- fixed values: corpus preparation -------------------------------------
MIN_CHARS = 600                 # cleaned documents shorter than this are "short"
SHORT_LINE_CHARS = 40           # a line shorter than this (unstripped) is short
MAX_SHORT_LINE_RATIO = 0.5      # at most this share of short lines is prose
BATCH_ROWS = 1000               # rows per read batch; the size cut-off is per batch
BYTES_PER_TOKEN_ESTIMATE = 3.2  # rough token estimate before a tokenizer exists
VAL_FRACTION = 0.01             # last share of corpus bytes held out

# --- fixed values: tokenizer ----------------------------------------------
END_OF_TEXT = "<|endoftext|>"   # id 0
N_BYTE_SYMBOLS = 256            # ids 1..256 are the bytes 0..255
MIN_PAIR_FREQUENCY = 2          # a pair must occur at least this often to merge
MAX_VOCAB = 65536               # token ids must fit 16 bits

# Byte-level pre-tokenisation pattern (GPT-2 family), as used by the
# tokenizer library the reference trains with.
PIECE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                 r"|\s+(?!\S)|\s+")

# Probe words: nine German compounds and one plain sentence.
COMPOUNDS = [
    "Hauptbahnhof",
    "Krankenversicherung",
    "Aufenthaltserlaubnis",
    "Wohnungsgeberbestätigung",
    "Geschwindigkeitsbegrenzung",
    "Bundesausbildungsförderungsgesetz",
    "Arbeitsunfähigkeitsbescheinigung",
    "Donaudampfschifffahrtsgesellschaft",
    "Rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz",
]
SAMPLE_SENTENCE = (
    "Der Hauptbahnhof in Berlin ist der größte Kreuzungsbahnhof Europas und "
    "wurde im Jahr 2006 nach elf Jahren Bauzeit eröffnet."
)
CONTEXT_TOKENS = 256            # words per 256 tokens

# --- fixed values: training schedule, evaluation, sampling -----------------
WARMUP_START_FACTOR = 0.02      # linear warmup from 0.02*lr to lr
COSINE_END_FACTOR = 0.1         # cosine decay from lr to 0.1*lr
EMA_DECAY = 0.9                 # running loss: 0.9*old + 0.1*new
PERPLEXITY_CLAMP = 20.0         # exp(min(loss, 20)) in the progress line
EVAL_SEED = 7                   # every evaluation draws the same batches
TRAIN_SEED = 1337               # window sampling seed is 1337 + start step
DRAW_EPSILON = 1e-10            # added to probabilities before the draw
FFN_MULTIPLE = 64               # feed-forward width rounded up to this
ROPE_BASE_DEFAULT = 10000

# Model configurations shipped with the reference (name, layers, heads, width,
# block, vocab, batch, steps, learning rate, warmup, eval every, eval batches,
# checkpoint every).
CONFIGS = [
    ("base", 10, 8, 512, 512, 16384, 24, 12000, 0.0004, 300, 500, 40, 500),
    ("mid", 5, 4, 256, 256, 16384, 32, 12000, 0.000735, 200, 250, 40, 500),
    ("nano", 4, 4, 128, 128, 16384, 16, 200, 0.001, 20, 50, 10, 100),
    ("small", 8, 8, 384, 256, 16384, 32, 12000, 0.0006, 200, 250, 40, 500),
    ("tiny", 4, 4, 128, 256, 16384, 32, 12000, 0.001039, 200, 250, 40, 500),
]
STUDY_ARCH = "mid"
STUDY_STEPS = 4000
