"""cuemill.plans"""
