"""Ten operators for preparing training text at scale.

Nothing outside this folder imports it; the folder can be removed and the rest
of the library keeps working.
"""
