"""Empty: no operator here is a stream. Hash assignment (``operators.assign``) is stateless and may be used in one."""
