from .keys import (absent_key, canonical_number, csv_key, key_token, plain_double, row_key, token_key,
                   typed_key)
from .register import register
from .scalars import (bare_name, bucket, canonical_type, deprecation_state, guarded_ratio, hash_pii, input_leaf,
                      mask, meta_pairs, month_label, normalize_path, parse_relation, sorted_tags, surrogate_key,
                      text_references)

__all__ = [name for name in dir() if not name.startswith("_")]
