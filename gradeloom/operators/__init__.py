"""DataFrame operators of the marking domain."""
