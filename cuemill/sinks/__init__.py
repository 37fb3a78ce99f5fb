"""cuemill.sinks"""
