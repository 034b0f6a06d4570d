from erascope.functions.numeric import nan_if_null, norm_ppf, rounded, safe_div, signed_power, with_norm_ppf

__all__ = ["nan_if_null", "norm_ppf", "rounded", "safe_div", "signed_power", "with_norm_ppf"]
