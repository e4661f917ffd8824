"""lociweave.plans"""
