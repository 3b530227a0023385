"""busline.plans"""
