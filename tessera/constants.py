"""Fixed values that must agree with the behaviour being reproduced.

Fixed values (stated plainly, in natural order):
- end-of-text token: "<|endoftext|>"  (GPT-2 eos; also used as pad when no pad exists)
- mask token added as an extra special: "<|MASK|>"
- ignore label: -100
- pre-tokenization split pattern: the public GPT-2 byte-level BPE pattern
  's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?other|whitespace-not-before-nonspace|whitespace
- BLEU: 4-gram, uniform weights 0.25, smoothing "method 1" with epsilon 0.1
- BLEU sample size during evaluation: 10 rows
- masking ratio for random token masking: 0.15
- map-batch rows default 6000 (configs use 40000); validation share default 5 %
- output shard cap 5 GB
"""

EOS_TOKEN = "<|endoftext|>"
MASK_TOKEN = "<|MASK|>"
UNK_TOKEN = "<unk>"
IGNORE_INDEX = -100

# GPT-2 split pattern (Java regex; (?U) makes \s Unicode whitespace, as in the original).
GPT2_PATTERN = r"""(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLEU_MAX_N = 4
BLEU_EPSILON = 0.1
BLEU_SAMPLE_ROWS = 10
MASK_RATIO = 0.15
DEFAULT_BATCH_ROWS = 6000
DEFAULT_VALIDATION_PERCENT = 5
SHARD_BYTES = 5 * 1024 ** 3
