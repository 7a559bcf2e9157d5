from .columns import (CURVE_SLOPE, NORMAL_TOKEN, binary_class, class_name, epoch_micros, hash_bucket, logistic_curve,
                      ok_ko, pair_key, pair_key_part, sigmoid, strip_terminator, vocabulary_class)

__all__ = ["CURVE_SLOPE", "NORMAL_TOKEN", "binary_class", "class_name", "epoch_micros", "hash_bucket",
           "logistic_curve", "ok_ko", "pair_key", "pair_key_part", "sigmoid", "strip_terminator", "vocabulary_class"]
