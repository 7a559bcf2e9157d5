from .containment import class_frequency_join, contained_entries, gram_index, vocabulary_class_join
from .diagnose import SeparableError, Separation, score_equations, separation
from .dictionary import (category_dictionary, dictionary_index, dictionary_widths, hash_collisions, hashed_slots,
                         read_dictionary, sparse_slots)
from .encode import (assemble, category_labels, category_stages, category_widths, encode_categories,
                     fit_category_encoders, fit_scaler, one_hot_columns, scale, scaler, scaler_stats, vector_columns)
from .evaluate import (confusion_counts, confusion_matrix, error_rate, evaluate, evaluator_accuracy, matrix_error,
                       matrix_from_keys, ok_ko_counts, prediction_pairs)
from .labels import (binary_label, binary_label_frequency, class_frequency, collect_vocabulary, known_classes,
                     label_frequency, label_vocabulary, multinomial_label)
from .merge import merge_features, merge_frames, zip_by_position
from .model import (build_pipeline, drop_versions, fit_checked, fit_logistic, load_model, logistic, lr_weights,
                    model_versions, save_model, score,
                    score_with_weights)
from .projections import drop_columns, drop_positions, project_categorical, project_label, project_numeric
from .sequence import expand_copies, order_blocks, row_id
from .splits import hash_split, random_split, row_split, split_union
from .stages import ClassLabeler, ClassLabelerModel
from .traffic import (attack_category, category_rollup, last_n_host_window, same_host_window,
                      same_service_window)

__all__ = [n for n in dir() if not n.startswith("_")]
