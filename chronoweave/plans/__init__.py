"""chronoweave.plans"""
