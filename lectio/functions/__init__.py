from .text import (TOKEN_PATTERN, WORD_PATTERN, SENT_END_PATTERN, VOWEL_GROUP_PATTERN,
                   tokens, word_tokens, whitespace_words, whitespace_word_count,
                   tokenized_text, truncate_words, syllable_count, sentence_count,
                   file_key, argmax, safe_div)

__all__ = ["TOKEN_PATTERN", "WORD_PATTERN", "SENT_END_PATTERN", "VOWEL_GROUP_PATTERN",
           "tokens", "word_tokens", "whitespace_words", "whitespace_word_count",
           "tokenized_text", "truncate_words", "syllable_count", "sentence_count",
           "file_key", "argmax", "safe_div"]
